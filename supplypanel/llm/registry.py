"""The registered queries of the package, and the SQL that some must agree with."""

from __future__ import annotations

from .decontamination import op10_decontamination
from .html_extraction import op8_html_extraction
from .license_scan import op12_license_scan
from .line_dedup import OP6_SQL, op6_line_dedup
from .near_vectors import op7_embedding_near_dedup
from .ngram_join import op5_ngram_jaccard
from .packing import op9_best_fit_packing
from .phrases import OP13_SQL, op13_phrase_mining
from .sharding import op2_sharding
from .token_counts import op1_token_counts
from .toxicity import op3_toxicity
from .url_filter import op4_url_filter
from .whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sharding,
        op3_toxicity,
        op4_url_filter,
        op5_ngram_jaccard,
        op6_line_dedup,
        op7_embedding_near_dedup,
        op8_html_extraction,
        op9_best_fit_packing,
        op10_decontamination,
        op11_embedding_whitening,
        op12_license_scan,
        op13_phrase_mining,
    )
}

ORACLE: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op13_phrase_mining": OP13_SQL}
