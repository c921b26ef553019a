"""Schemas of the canonical tables. Order is explicit in every one of them."""

BOX = "x1 int, y1 int, x2 int, y2 int"
PAGES = "page_id string, page_no int, height int, width int, channels int, pixels binary"
BINARY_PAGES = f"{PAGES}, method string, scores map<string,double>, stages array<string>, angle double"
PROFILE = "page_id string, y int, ink long"
BOXES = f"page_id string, seq int, {BOX}"
WORDS = f"page_id string, idx int, {BOX}"
COMPONENTS = "page_id string, label int, x int, y int, w int, h int, area long, cx double, cy double"
TOKENS = "doc_id string, line_index int, tok_index int, tok string, p double"
LINES = "doc_id string, line_index int, raw_text string, confidence double, difficulty_tag string, needs_review boolean"
EVAL_PAIRS = "sample_id long, prediction string, reference string, tag string"
WORD_CONFIDENCE = "struct<word:string,confidence:double,low:boolean>"
