"""Regular expressions in the part of the language that Java and RE2 share, so that the queries and their SQL
use the same text. White space and word characters are those of Unicode."""

from __future__ import annotations

SPACE = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\pZ"
WS = f"[{SPACE}]"
NOT_WS = f"[^{SPACE}]"
WORD = r"[\pL\pN_]"

LINK = f"https?://{NOT_WS}+"
MENTIONS = f"^(@{WORD}+[{SPACE},]*)+"
EDGES = f"^{WS}+|{WS}+$"
ALPHA = r"^[A-Za-z']+$"
PUNCTUATION = rf"^[^\pL\pN_{SPACE}]+$"
SYMBOLS_ONLY = r"^[^\pL_\p{Nl}\p{No}]+$"
DIGIT = r"\p{Nd}"

#: What separates sentences, and what must not: (pattern, replacement with $ groups).
DOT, CUT = "", ""
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\\.g|i\\.e|Inc|Ltd|Co|No|Fig|approx|[A-Z]"
SENTENCE_RULES = [
    (rf"(^|[^\pL])({ABBREVIATIONS})\.({WS})", f"$1$2{DOT}$3"),
    (rf"(^|[^\pL])({ABBREVIATIONS})\.({WS})", f"$1$2{DOT}$3"),
    (rf"([.!?]+[\"'”’»)\]]*){WS}+", f"$1{CUT}"),
]
#: Word tokens of a sentence by the conventions of the Penn Treebank, in order. Fixed values.
TOKEN_RULES = [
    (r'^"', "`` "),
    (r"([ (\[{<])\"", "$1 `` "),
    (r"([^.])(\.)([\])}>\"'»”’ ]*) *$", "$1 $2 $3 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"(\.\.+)", " $1 "),
    (r"([;@#$%&])", " $1 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r"$", " "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
]
