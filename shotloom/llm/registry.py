"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bin_packing import op8_bin_packing
from .decontaminate import op1_decontaminate
from .language_mixture import op6_language_mixture
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op9_license_scan
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import op12_line_dedup
from .pseudonyms import op4_feistel_pseudonyms
from .quality_rules import op7_quality_rules
from .quantile_summaries import op11_quantile_summaries
from .similarity_join import ORACLE as JACCARD_SQL
from .similarity_join import op10_ngram_jaccard_join
from .source_mixing import ORACLE as MIXING_SQL
from .source_mixing import op3_source_mixing
from .token_counts import op2_token_counts
from .url_filters import ORACLE as URL_SQL
from .url_filters import op5_url_filters
from .vector_codes import ORACLE as CODES_SQL
from .vector_codes import op13_vector_codes

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_source_mixing": op3_source_mixing,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_url_filters": op5_url_filters,
    "op6_language_mixture": op6_language_mixture,
    "op7_quality_rules": op7_quality_rules,
    "op8_bin_packing": op8_bin_packing,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_quantile_summaries": op11_quantile_summaries,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: The other operators learn, iterate, pack, hash with Spark's functions or call a tokenizer; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op3_source_mixing": MIXING_SQL, "op5_url_filters": URL_SQL, "op9_license_scan": LICENSE_SQL, "op10_ngram_jaccard_join": JACCARD_SQL, "op12_line_dedup": LINES_SQL, "op13_vector_codes": CODES_SQL}
