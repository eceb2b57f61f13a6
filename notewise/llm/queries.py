"""The queries of this folder, by name, and DuckDB SQL for those that SQL can
express."""

from __future__ import annotations

from . import op7_chat_format as _chat
from . import op8_fair_queue_mix as _mix
from . import op11_centroid_clusters as _clusters
from . import op13_divergence_audit as _audit
from .op1_hmm_lm import op1_hmm_lm
from .op2_block_rules import op2_block_rules
from .op3_gbt_quality import op3_gbt_quality
from .op4_separator_scan import op4_separator_scan
from .op5_fragment_join import op5_fragment_join
from .op6_byte_cnn import op6_byte_cnn
from .op7_chat_format import op7_chat_format
from .op8_fair_queue_mix import op8_fair_queue_mix
from .op9_latent_decontaminate import op9_latent_decontaminate
from .op10_kneser_ney_langid import op10_kneser_ney_langid
from .op11_centroid_clusters import op11_centroid_clusters
from .op12_window_packing import op12_window_packing
from .op13_divergence_audit import op13_divergence_audit

QUERIES = {f.__name__: f for f in (
    op1_hmm_lm, op2_block_rules, op3_gbt_quality, op4_separator_scan, op5_fragment_join, op6_byte_cnn, op7_chat_format,
    op8_fair_queue_mix, op9_latent_decontaminate, op10_kneser_ney_langid, op11_centroid_clusters, op12_window_packing,
    op13_divergence_audit)}
ORACLE: dict[str, str] = {
    "op7_chat_format": _chat.ORACLE, "op8_fair_queue_mix": _mix.ORACLE, "op11_centroid_clusters": _clusters.ORACLE,
    "op13_divergence_audit": _audit.ORACLE}
