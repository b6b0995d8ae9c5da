"""The registered queries of this subpackage and their SQL for DuckDB."""

from .bpe import op6_byte_bpe
from .divergence import OP11_SQL, op11_source_divergence
from .lines import op10_fuzzy_lines
from .minhash import op1_minhash_dedup
from .packing import op5_packing
from .partenum import op12_jaccard_join
from .pii import op3_pii
from .quality import OP2_SQL, op2_quality_rules
from .shard import op7_sharding
from .substrings import op4_substring_dedup
from .tiff import op9_media_tiff
from .urls import OP8_SQL, op8_url_filters
from .whitening import op13_embedding_whitening

QUERIES = {
    "op3_pii": op3_pii,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op4_substring_dedup": op4_substring_dedup,
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op5_packing": op5_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_media_tiff": op9_media_tiff,
    "op11_source_divergence": op11_source_divergence,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES = {"op2_quality_rules": OP2_SQL, "op8_url_filters": OP8_SQL, "op11_source_divergence": OP11_SQL}
