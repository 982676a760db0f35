"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import op8_url_filter as url_filter
from . import op11_fim as fim
from . import op12_decontaminate as decontaminate
from . import op13_prefix_trie as trie
from .op1_bpe import op1_bpe_round_trip
from .op2_license import op2_license
from .op3_jaccard import op3_jaccard_join
from .op4_suffix_dedup import op4_suffix_dedup
from .op5_secrets import op5_secrets
from .op6_quality import op6_quality
from .op7_language import op7_language
from .op9_packing import op9_pack
from .op10_fingerprint import op10_fingerprint

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_license": op2_license,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_pack": op9_pack,
    "op10_fingerprint": op10_fingerprint,
    "op11_fim": fim.op11_fim,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

#: Queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_url_filter": url_filter.SQL,
    "op11_fim": fim.SQL,
    "op12_decontaminate": decontaminate.SQL,
    "op13_prefix_trie": trie.SQL,
}
