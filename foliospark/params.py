"""Thresholds and patterns of the document model. They must stay as they are for results to agree."""

from __future__ import annotations

# Page probes
IMAGE_TEXT_OVERLAP = 0.2
MIXED_MIN_IMAGE_SHARE = 0.08
SCANNED_IMAGE_SHARE, SCANNED_TEXT_DENSITY = 0.8, 0.08
PARTIAL_SCAN_IMAGE_SHARE, PARTIAL_SCAN_TEXT_DENSITY = 0.5, 0.02
POINTS_PER_INCH = 72
CHART_VECTORS, CHART_MEAN_LENGTH, CHART_NUMBERS = 10, 18, 4
ROTATED_DEGREES = 5
RULE_MIN_LENGTH, RULE_MAX_THICKNESS, RULE_MIN_ASPECT = 4, 2, 8
CELL_GAP = 8
COLUMN_BINS, COLUMN_SEARCH, COLUMN_OCCUPANCY = 120, (0.3, 0.7), 0.12
COLUMN_MIN_GUTTER, COLUMN_MAX_GUTTER_SHARE, COLUMN_SIDE_SHARE, COLUMN_PURITY = 8, 0.16, 0.2, 0.92
COLUMN_PERTURBATION, COLUMN_MOST = 0.2, 4

# Text layer
REPLACEMENT_RATE, CID_RATE, SUSPICIOUS_RATE, LEAST_SUSPICIOUS = 0.01, 0.02, 0.01, 2
LANGUAGE_MIN_CHARS, LANGUAGE_MIN_WORDS, GIBBERISH_SHARE, HAN_DOCUMENT_SHARE = 40, 8, 0.22, 0.1

# Furniture and continuations
EDGE_BAND, POSITION_BIN, REPEAT_PAGES, REPEAT_SHARE, MAX_CHARS = 0.14, 0.015, 2, 0.3, 180
POSITION_WEIGHT, CONTENT_WEIGHT, PAGE_NUMBER_DIGITS = 0.45, 0.55, 0.6
LOCAL_BAND, LOCAL_ZONE, LOCAL_CHARS, LOCAL_CONFIDENCE = 0.08, 0.18, 4, 0.86
CONTINUATION_BAND, CONTINUATION_CHARS = 0.12, 2
CONTINUATION = {"table": 0.84, "list": 0.78, "paragraph": 0.72}

# Font profile
BUCKET, HEADING_RATIO, BODY_SHARE, HEADING_SHARE, HEADING_CHARS, HEADING_LEVELS = 0.5, 1.08, 0.2, 0.35, 8, 3
HEADING_LINES, HEADING_MAX = 2, 80
MONOSPACE_SHARE, FORMULA_CENTER, FORMULA_LATIN, NUMERIC_HEADING_MAX = 0.8, 0.06, 3, 48
SPANNING_SHARE = 0.5

# Assembly
LIST_GAP, TABLE_COLUMN_TOLERANCE, TABLE_EDGE = 2.5, 2, 0.2
HEADER_SHARE, INTERSECTION_TOLERANCE, OWNED_CONTAINMENT = 0.6, 0.25, 0.9
CAPTION_OVERLAP, CAPTION_GAP = 0.5, 2.5
VERDICT_WEIGHTS, VERDICT_MAX = (0.28, 0.22, 0.19), 0.30

# Patterns (Java syntax)
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MARKER = r"^(?:[-*•▪◦]|[0-9]+[.)、．])$"
SYMBOL_FONT = r"(?i)(?:wingdings|webdings|zapf\s*dingbats|dingbat|symbol|marlett|monotypesorts)"
SYMBOL_CODES = (0x6C, 0x6E, 0x6F, 0x75, 0x76, 0xA7, 0xA8, 0xB7, 0xD8, 0xFC)
PRIMARY_HEADING = r"^(?:[IVXLCDM]+\.\s+|[一二三四五六七八九十百]+[、.．]\s*)"
SECONDARY_HEADING = r"^(?:[A-Z]\.\s+|[（(](?:[一二三四五六七八九十百]+|[0-9]+)[）)]\s*)"
NUMERIC_HEADING = r"^[0-9]{1,2}(?:\.[0-9]{1,2})*\s+[^0-9\s]"
LIST_START = r"^(?:[0-9]+[、.)]|[-*•▪◦]\s*)"
FIGURE_CAPTION = r"(?i)^(?:fig(?:ure)?\.?\s*[0-9]+\s*[:.]?)"
HEADING_TAIL = r"[.。．!！?？;；:：,，、)）\]】》」』]$"
MONOSPACE = r"(?i)(?:mono|courier|typewriter|t1x(?:b)?tt)"
MATH_FONT = r"(?i)(?:math|symbol|cmmi|cmsy|rtx)"
TERMINAL = r"[。！？.!?;；:：]$"
LIST_PREFIX = r"^\s*(?:[-*•▪◦]|\(?[0-9]+[.)、]|[（(]?[一二三四五六七八九十]+[）)、.])"
NUMERIC_CELL = r"^[-+（(]?[0-9,.]+%?[）)]?$"
TABLE_LABEL = r"(?i)^(?:TABLE\s+[IVXLCDM0-9]+|表\s*[一二三四五六七八九十0-9]+|[一二三四五六七八九十]+[、.])"
