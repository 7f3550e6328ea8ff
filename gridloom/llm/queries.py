"""The op queries and, where SQL can express them, their SQL."""

from gridloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from gridloom.llm.language_model import op2_deleted_interpolation
from gridloom.llm.mixing import OP10_SQL, op10_source_mix
from gridloom.llm.near_dedup import op5_near_dedup
from gridloom.llm.outliers import op7_robust_outliers
from gridloom.llm.packing import op6_best_fit_packing
from gridloom.llm.pii import op4_personal_data
from gridloom.llm.quality import op3_quality
from gridloom.llm.token_counts import op9_token_counts
from gridloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_quality": op3_quality,
    "op4_personal_data": op4_personal_data,
    "op5_near_dedup": op5_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_source_mix": op10_source_mix,
}

ORACLES = {"op8_exact_dedup": OP8_SQL, "op10_source_mix": OP10_SQL}
