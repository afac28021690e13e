"""Operators of a training-data pipeline and their registered queries."""

from anchorage.llm import centroids, collocations, line_dedup, near_dedup, quality
from anchorage.llm.centroids import op12_centroid_clustering
from anchorage.llm.collocations import op11_collocations
from anchorage.llm.language import op10_language_id
from anchorage.llm.licences import op3_licence_scan
from anchorage.llm.line_dedup import op13_line_dedup
from anchorage.llm.mixing import op9_mixing
from anchorage.llm.near_dedup import op1_near_dedup
from anchorage.llm.nearest import op5_nearest_neighbours
from anchorage.llm.packing import op2_best_fit_packing
from anchorage.llm.quality import op7_quality_rules
from anchorage.llm.recount import op6_token_counts
from anchorage.llm.repeats import op8_suffix_dedup
from anchorage.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_best_fit_packing,
        op3_licence_scan,
        op4_toxicity,
        op5_nearest_neighbours,
        op6_token_counts,
        op7_quality_rules,
        op8_suffix_dedup,
        op9_mixing,
        op10_language_id,
        op11_collocations,
        op12_centroid_clustering,
        op13_line_dedup,
    )
}
ORACLES = {
    "op1_near_dedup": near_dedup.SQL,
    "op7_quality_rules": quality.SQL,
    "op11_collocations": collocations.SQL,
    "op12_centroid_clustering": centroids.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
