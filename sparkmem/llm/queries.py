"""The registered queries of this package and their SQL counterparts."""

from .decontamination import OP6_SQL, op6_prefix_filtered_join
from .importance import OP12_SQL, op12_importance_resampling
from .lmscore import op7_cross_entropy_difference
from .materialise import op5_training_order
from .neardup import op10_weighted_minhash
from .packing import op2_mixture_packing
from .pii import op4_surrogates
from .quality import op3_attention_quality
from .rules import op9_adaptive_rules
from .sharding import op1_histogram_sharding
from .toxicity import op8_toxic_segments
from .warc import op13_archive_index
from .whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_sharding, op2_mixture_packing, op3_attention_quality, op4_surrogates, op5_training_order,
        op6_prefix_filtered_join, op7_cross_entropy_difference, op8_toxic_segments, op9_adaptive_rules, op10_weighted_minhash,
        op11_embedding_whitening, op12_importance_resampling,
        op13_archive_index,
    )
}
ORACLES = {"op6_prefix_filtered_join": OP6_SQL, "op12_importance_resampling": OP12_SQL}
