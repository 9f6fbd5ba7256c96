"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from spanloom.llm.crf import op2_crf
from spanloom.llm.extraction import op6_extraction
from spanloom.llm.hamerly import OP13_SQL, op13_hamerly
from spanloom.llm.linelevels import OP12_SQL, op12_line_levels
from spanloom.llm.mixing import OP8_SQL, op8_mixing
from spanloom.llm.pieces import op3_pieces
from spanloom.llm.repeats import op11_runs
from spanloom.llm.rules import OP5_SQL, op5_line_frequency
from spanloom.llm.simhash import op9_simhash
from spanloom.llm.sketches import op10_fingerprints
from spanloom.llm.suffixes import op7_suffixes
from spanloom.llm.tokens import op1_tokens
from spanloom.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_tokens, op2_crf, op3_pieces, op4_warc, op5_line_frequency, op6_extraction, op7_suffixes, op8_mixing, op9_simhash, op10_fingerprints, op11_runs, op12_line_levels, op13_hamerly)}
ORACLES = {"op5_line_frequency": OP5_SQL, "op8_mixing": OP8_SQL, "op12_line_levels": OP12_SQL, "op13_hamerly": OP13_SQL}
