"""Scan patterns, as data. A pattern is (usage kind, regular expression, confidence); its first group is
the column, in Python patterns the second is the data frame. More rows may be passed to the scans."""

from __future__ import annotations

# SAS words that are never columns.
SAS_WORDS = """
calculated case when then else end having where from as null distinct union select by on and or not is in
max min sum avg count mean var std range abs log log2 log10 exp sqrt floor ceil round int mod lag dif missing
coalesce nmiss cmiss rand ranuni streaminit
substr cats catx compress upcase lowcase put input length index scan strip trim tranwrd translate left right
find verify
mdy datepart intnx intck today date datetime time year month day weekday qtr hms dhms
run quit do to while until if output set merge data proc format informat options macro mend let global local
""".split()

# SAS reference patterns (what, pattern), applied to statements.
SAS_INPUTS = [("set", r"(?i)\bset\s+([a-zA-Z0-9_.]+)"), ("from", r"(?i)\bfrom\s+([a-zA-Z0-9_.]+)"), ("data=", r"(?i)\bdata\s*=\s*([a-zA-Z0-9_.]+)")]
SAS_MERGE = r"(?i)\bmerge\s+([a-zA-Z0-9_.\s()=]+)$"
SAS_OUTPUTS = [r"(?i)\bdata\s+([a-zA-Z0-9_.]+)\s*$", r"(?i)\bcreate\s+table\s+([a-zA-Z0-9_.]+)", r"(?i)\boutput\s+out\s*=\s*([a-zA-Z0-9_.]+)"]
SAS_OPENERS = r"(?i)\bdata\s+([a-zA-Z0-9_.]+)\s*$|\bcreate\s+table\s+([a-zA-Z0-9_.]+)\s+as\b"
SAS_CLOSER = r"(?i)\b(?:run|quit)\s*$"
SAS_LIBNAME = r"(?i)\blibname\s+(\w+)\s+[\"']?([^\"';]+)"
SAS_AGGREGATES = r"(?i)\bproc\s+(?:means|summary|freq)\b"

# SAS usage patterns on one statement. A column list is split at commas and spaces.
SAS_USAGES = [
    ("denominator", r"/\s*([a-zA-Z_]\w*)\b(?!\s*\()", "High"),
    ("by", r"(?i)(?<!\b(?:group|order)\s{1,9})\bby\s+([a-zA-Z0-9_.\s]+?)\s*$", "High"),
    ("aggregated", r"(?i)\bgroup\s+by\s+([a-zA-Z0-9_.,\s]+?)\s*(?:$|\bhaving\b|\border\b)", "High"),
    ("date_parse", r"(?i)\b(?:datepart|mdy|intnx)\s*\(\s*(\w+)", "High"),
    ("type_cast", r"(?i)\binput\s*\(\s*(\w+)", "High"),
    ("time_window", r"(?i)\bwhere\b[^;]*?\b(\w+)\s+between\b", "High"),
    ("range_filter", r"(?i)\bwhere\b[^;]*?\b(\w+)\s*(?:>|<)\s*\d", "High"),
    ("equality_set", r"(?i)\b(\w+)\s+in\s*\(", "High"),
    ("on", r"(?i)\bon\s+\w+\.(\w+)\s*=", "High"),
]
#: What a match holds, in small letters: statements without it are not searched.
SAS_SIGNS = {rx: signs for (_, rx, _), signs in zip(SAS_USAGES, [("/",), ("by",), ("group",), ("datepart", "mdy", "intnx"), ("input",), ("between",), ("where",), ("in",), ("on",)], strict=True)}
SAS_ASSIGN = r"(?m)^\s*(\w+)\s*=(?!=)"
SAS_KEEP = r"(?i)\bkeep\s+([\w\s]+)$"

# Python, on logical lines. Brackets are matched LEVELS deep and strings stand as wholes; all loops over them are
# possessive, so neither backtracking nor the stack grows with a script.
LEVELS = 24
_STR = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"


def _within(levels: int) -> str:
    """What stands between a pair of brackets."""
    inner = rf"(?:[^()\[\]{{}}\"']++|{_STR})*+"
    for _ in range(levels):
        inner = rf"(?:[^()\[\]{{}}\"']++|{_STR}|[(\[{{]{inner}[)\]}}])*+"
    return inner


_IN = _within(LEVELS)
#: A logical line: up to a line end outside of brackets that no backslash continues. A bracket without a partner
#: stands for itself, so a broken script falls back to its physical lines.
PY_LOGICAL = rf"(?:[^()\[\]{{}}\"'\n\\]++|{_STR}|\\\r?\n|[(\[{{]{_IN}[)\]}}]|.)*+(?:\n|\z)"
#: Arguments of a call before the one that is sought, and a string as a whole argument.
_ARGS = rf"\s*(?:(?:[^()\[\]{{}},\"']++|{_STR}|[(\[{{]{_within(8)}[)\]}}])*+,\s*){{0,64}}?"
_TEXT = r"[rRuU]?[\"']([^\"']+)[\"']"
#: The data frame that a method is called on, where it is a plain name, and the call.
_CALL = r"(?:(?<![\w.)\]])([A-Za-z_]\w*)\s*)?\.\s*{}\s*\("
#: A column of a data frame at the left and at the right of an operator: the frame, where it is a plain name; the column.
_SUB = r"(?:(?<![\w.)\]\"'])([A-Za-z_]\w*)|[\w)\]])\s*\[\s*[\"']([^\"']+)[\"']\s*\]"
_RIGHT = r"(?:([A-Za-z_]\w*)|[A-Za-z_][\w.]*)\s*\[\s*[\"']([^\"']+)[\"']\s*\]"
#: What makes an operand part of another one.
_MORE = r"(?!\s*(?:[\[(]|\.\s*[A-Za-z_]|\*\*))"
_OVER = r"(?<!/)/(?![/=])\s*"
_NUMBER = r"(?:\d[\w.]*+|\.\d\w*+)(?:(?<=[eE])[-+]\d+)?+(?!\s*(?:[-+*/%@.\[(<>]|[!=]=))"

_READERS = "read_csv|read_parquet|read_table|read_excel|read_json"
PY_READ = rf"(?:^|;)\s*([A-Za-z_]\w*)\s*=\s*(?:\(\s*)*[\w.]+\s*\.\s*({_READERS}|read_sql)\s*\(\s*{_TEXT}\s*(?:,{_IN})?\)(?:\s*\))*\s*(?:;|\z)"
PY_READ_ANY = rf"\.\s*({_READERS})\s*\(\s*{_TEXT}\s*[,)]"
PY_READ_KIND = rf"\.\s*({_READERS}|read_sql)\s*\("
_WRITERS = "to_csv|to_parquet|to_sql|to_excel|to_json"
PY_WRITE = rf"\.\s*({_WRITERS})\s*\(\s*{_TEXT}\s*[,)]"
PY_WRITE_KIND = rf"\.\s*({_WRITERS})\s*\("
#: (kind, pattern, group of the column, group of the data frame or 0, evidence or "" for the match; {} in it stands for the column).
PY_USAGES = [
    ("join_key", rf"{_CALL.format('merge')}(?={_ARGS}on\s*=\s*{_TEXT}\s*[,)])", 2, 1, ".merge(on='{}')"),
    ("join_key", rf"{_CALL.format('join')}(?={_ARGS}on\s*=\s*{_TEXT}\s*[,)])", 2, 1, ".join(on='{}')"),
    ("aggregated", rf"{_CALL.format('groupby')}\s*{_TEXT}\s*[,)]", 2, 1, ".groupby(...)"),
    ("date_parse", rf"\.\s*to_datetime\s*\(\s*{_RIGHT}\s*[,)]", 2, 1, "to_datetime(...)"),
    ("type_cast", rf"{_SUB}\s*\.\s*astype\s*\(", 2, 1, ".astype(...)"),
    ("equality_set", rf"{_SUB}\s*\.\s*isin\s*\(", 2, 1, ".isin([...])"),
    ("time_window", rf"{_SUB}\s*\.\s*between\s*\(", 2, 1, ".between(...)"),
    ("denominator", rf"{_OVER}{_RIGHT}{_MORE}", 2, 1, "x / <col>"),
    ("denominator", rf"{_OVER}\(\s*{_RIGHT}\s*\){_MORE}", 2, 1, "x / <col>"),
    ("denominator", rf"{_OVER}\(\s*\(\s*{_RIGHT}\s*\)\s*\){_MORE}", 2, 1, "x / <col>"),
    ("denominator", rf"{_OVER}([A-Za-z_]\w*+){_MORE}", 1, 0, "x / <col>"),
    ("denominator", rf"{_OVER}\(\s*([A-Za-z_]\w*+)\s*\){_MORE}", 1, 0, "x / <col>"),
    ("range_filter", rf"(?<![-+*/%@<>]\s{{0,9}}){_SUB}\s*(?:>=|<=|>|<)\s*{_NUMBER}", 2, 1, "df[col] > n"),
]
#: What a match holds: lines without it are not searched.
PY_SIGNS = {rx: signs for (_, rx, *_), signs in zip(PY_USAGES, [("merge",), ("join",), ("groupby",), ("to_datetime",), ("astype",), ("isin",), ("between",), *[("/",)] * 5, ("<", ">")], strict=True)}
PY_ASSIGN = rf"(?:^|;)\s*{_SUB}\s*=(?!=)"

# R patterns on a whole script without comments.
_R_READ = r"(?:read_csv2?|read\.csv|read_delim|read_tsv|read_parquet|read_excel|read_xlsx|readRDS|fread)"
_R_WRITE = r"(?:write_csv2?|write\.csv|write_delim|write_tsv|write_parquet|write_xlsx|saveRDS|fwrite)"
R_READ = rf"(?i)\b{_R_READ}\s*\(\s*[\"']([^\"']+)[\"']"
R_WRITE = rf"(?i)\b{_R_WRITE}\s*\(\s*[^,]+,\s*[\"']([^\"']+)[\"']"
R_WRITE_DF = rf"(?i)\b{_R_WRITE}\s*\(\s*([A-Za-z_.][\w.]*)\s*,"
R_JOIN = r"(?i)\b(?:inner_join|left_join|right_join|full_join|semi_join|anti_join|merge)\s*\([^;]*?\bby\s*=\s*[\"']([^\"']+)[\"']"
R_GROUP = r"(?i)\bgroup_by\s*\(([^)]*)\)"
R_FILTER = r"(?i)\bfilter\s*\(([^)]*)\)"
R_FILTER_COL = r"([A-Za-z_]\w*)\s*(?:>=|<=|>|<)\s*[\d.]"
R_DIVISOR = r"/\s*(?:[\w.]+\$)?([A-Za-z_]\w*)"
R_ASSIGN = r"\b(\w+)\$(\w+)\s*(?:<-|=)\s*[^=]"

# VBA patterns on one line.
VBA_BIND = r"(?i)\bSet\s+(\w+)\s*=\s*(?:\w+\.)*(?:Sheets|Worksheets)\(\s*\"([^\"]+)\"\s*\)"
VBA_ASSIGN = r"(?i)^\s*(\w+)\.(?:Cells|Range)\([^)]*\)(?:\.\w+)*\s*=(?!=)"
VBA_REF = r"(?i)(\w+)\.(?:Cells|Range|UsedRange)"
VBA_USAGES = [
    ("denominator", r"(?i)/\s*(\w+)\.Cells\(\s*\w+\s*,\s*(\d+)\s*\)"),
    ("range_filter", r"(?i)(\w+)\.Cells\(\s*\w+\s*,\s*(\d+)\s*\)(?:\.Value)?\s*(?:>=|<=|>|<)\s*[\d.]"),
]
