"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from claimflow.llm.codebooks import ORACLE as CODEBOOKS_SQL
from claimflow.llm.codebooks import op13_vector_codes
from claimflow.llm.hamming import ORACLE as HAMMING_SQL
from claimflow.llm.hamming import op4_hamming_topk
from claimflow.llm.language import op1_language_id
from claimflow.llm.neardup import ORACLE as NEAR_SQL
from claimflow.llm.neardup import op5_near_duplicates
from claimflow.llm.neighbours import op7_nearest_neighbours
from claimflow.llm.packing import op10_best_fit_packing
from claimflow.llm.pages import op12_main_text
from claimflow.llm.pieces import op6_sampled_pieces
from claimflow.llm.pii import op3_pii_pseudonyms
from claimflow.llm.quality import op2_quality
from claimflow.llm.scoring import op8_lm_scores
from claimflow.llm.toxicity import op9_toxicity
from claimflow.llm.turns import ORACLE as TURNS_SQL
from claimflow.llm.turns import op11_conversation_repair

QUERIES = {
    q.__name__: q
    for q in (
        op1_language_id,
        op2_quality,
        op3_pii_pseudonyms,
        op4_hamming_topk,
        op5_near_duplicates,
        op6_sampled_pieces,
        op7_nearest_neighbours,
        op8_lm_scores,
        op9_toxicity,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_main_text,
        op13_vector_codes,
    )
}

ORACLES = {
    "op4_hamming_topk": HAMMING_SQL,
    "op5_near_duplicates": NEAR_SQL,
    "op11_conversation_repair": TURNS_SQL,
    "op13_vector_codes": CODEBOOKS_SQL,
}
