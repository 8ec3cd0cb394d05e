"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

Only the maintained view has SQL: DuckDB's patterns know no possessive quantifiers and no code point offsets of
all matches at once, and set joins, models, tokenizers and walks are beyond SQL on whole tables. Each
is tested against brute force, a reference library or held-out labels in ``tests/llm``.
"""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .embeddings import op4_embedding_near_dedup
from .fingerprint import op10_fingerprint
from .heavylight import ORACLE as _VIEW
from .heavylight import op11_view_maintenance
from .idfiles import op12_token_files
from .jaccard import op3_ngram_jaccard
from .langid import op9_language_id
from .mixing import op5_mixing
from .pii import op2_pii
from .quality import op1_quality
from .repeats import op13_periodic_runs
from .sharding import op6_sharding
from .toxicity import op8_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_fingerprint": op10_fingerprint,
    "op11_view_maintenance": op11_view_maintenance,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op11_view_maintenance": _VIEW}
