"""The corpus queries by name, and SQL for those that SQL can express."""

from fluxcell.llm.chat import OP9_SQL, op9_chat_formatting
from fluxcell.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from fluxcell.llm.filter_audit import OP12_SQL, op12_filter_audit
from fluxcell.llm.fingerprints import op4_fingerprints
from fluxcell.llm.language_id import op1_language_id
from fluxcell.llm.line_dedup import OP2_SQL, op2_line_dedup
from fluxcell.llm.mixing import op6_mixing
from fluxcell.llm.ngram_join import op10_ngram_join
from fluxcell.llm.pieces import op5_sentencepiece
from fluxcell.llm.quality import op3_quality_classifier
from fluxcell.llm.secret_scan import OP8_SQL, op8_secret_scan
from fluxcell.llm.spelling_variants import OP13_SQL, op13_spelling_variants
from fluxcell.llm.toxicity import op11_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_line_dedup,
        op3_quality_classifier,
        op4_fingerprints,
        op5_sentencepiece,
        op6_mixing,
        op7_embedding_dedup,
        op8_secret_scan,
        op9_chat_formatting,
        op10_ngram_join,
        op11_toxicity,
        op12_filter_audit,
        op13_spelling_variants,
    )
}

SQL = {
    "op2_line_dedup": OP2_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
