"""Schemas of the tables; none is ever inferred."""

DOCUMENTS = "doc_id long, text string"
PATTERNS = "pattern_id long, pattern string"
DOC_FREQ = "pattern_id long, doc_id long, freq long"
SUFFIXES = "rk long, doc_id long, pos int, key string"
INDEX = "rk long, doc_id long, pos int, key string, isa long, occ long, prev_rk long, next_rk long, ilcp_b int, ilcp_f int, min_b int, min_f int, block long"
BLOCKS = "block long, doc_id long, freq long, first_isa long, last_isa long"
RULES = "var long, left long, right long"
NODE_OCC = "var long, term long, first_pos long, last_pos long"
RUNS = "run_id long, start long, len long, value long"
