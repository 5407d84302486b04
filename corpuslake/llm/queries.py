"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .common import table
from .embedding_join import embedding_join_query
from .exact_dedup import EXACT_DEDUP_SQL, exact_dedup_query
from .language_id import language_id_query
from .license_scan import license_scan_query
from .mixing import MIXING_SQL, mixing_query
from .ngram_join import ngram_join_query
from .packing import packing_query
from .periodic_runs import periodic_runs_query
from .quality import quality_query
from .secret_scan import secret_scan_query
from .spelling_variants import spelling_variants_query
from .substring_dedup import substring_dedup_query
from .token_output import token_output_query

QUERIES = {
    "op1_packing": lambda spark, sf_dir: packing_query(table(spark, sf_dir, "documents")),
    "op2_language_id": lambda spark, sf_dir: language_id_query(table(spark, sf_dir, "documents")),
    "op3_license_scan": lambda spark, sf_dir: license_scan_query(table(spark, sf_dir, "documents")),
    "op4_exact_dedup": lambda spark, sf_dir: exact_dedup_query(table(spark, sf_dir, "documents")),
    "op5_mixing": lambda spark, sf_dir: mixing_query(table(spark, sf_dir, "documents")),
    "op6_substring_dedup": lambda spark, sf_dir: substring_dedup_query(table(spark, sf_dir, "documents")),
    "op7_secret_scan": lambda spark, sf_dir: secret_scan_query(table(spark, sf_dir, "documents")),
    "op8_embedding_join": lambda spark, sf_dir: embedding_join_query(table(spark, sf_dir, "embeddings")),
    "op9_ngram_join": lambda spark, sf_dir: ngram_join_query(table(spark, sf_dir, "documents")),
    "op10_quality": lambda spark, sf_dir: quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_token_output": lambda spark, sf_dir: token_output_query(table(spark, sf_dir, "documents")),
    "op12_spelling_variants": lambda spark, sf_dir: spelling_variants_query(table(spark, sf_dir, "documents")),
    "op13_periodic_runs": lambda spark, sf_dir: periodic_runs_query(table(spark, sf_dir, "documents")),
}
ORACLES = {"op4_exact_dedup": EXACT_DEDUP_SQL, "op5_mixing": MIXING_SQL}
