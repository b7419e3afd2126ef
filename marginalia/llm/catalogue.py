"""The training-data queries and their SQL."""

from marginalia.llm.bpe import op1_bpe
from marginalia.llm.chat import OP12_SQL, op12_chat
from marginalia.llm.codes import OP11_SQL, op11_codes
from marginalia.llm.fingerprints import op9_fingerprints
from marginalia.llm.jaccard import OP8_SQL, op8_jaccard
from marginalia.llm.lines import OP7_SQL, op7_line_dedup
from marginalia.llm.manifest import OP13_SQL, op13_manifest
from marginalia.llm.mixing import op2_mixing
from marginalia.llm.pii import op3_pii
from marginalia.llm.quality import OP4_SQL, op4_quality
from marginalia.llm.sharding import op6_sharding
from marginalia.llm.suffixes import op10_suffixes
from marginalia.llm.units import OP5_SQL, op5_substrings

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_substrings": op5_substrings,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard": op8_jaccard,
    "op9_fingerprints": op9_fingerprints,
    "op10_suffixes": op10_suffixes,
    "op11_codes": op11_codes,
    "op12_chat": op12_chat,
    "op13_manifest": op13_manifest,
}
ORACLE_SQL: dict[str, str] = {"op4_quality": OP4_SQL, "op5_substrings": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_jaccard": OP8_SQL, "op11_codes": OP11_SQL, "op12_chat": OP12_SQL, "op13_manifest": OP13_SQL}
