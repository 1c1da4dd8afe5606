"""Native string functions: escaping, lexing, demangling and the loose substring match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters and their escapes, in the order of replacement (the backslash comes first).
ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("\b", "\\b"), ("\v", "\\v"), ("\a", "\\a"), ("\f", "\\f"), ("\x1b", "\\x1B")]

# Operator names of special symbol codes. "0" and "1" are constructor and destructor; other codes with an empty
# name are ignored.
SPECIAL_NAMES = {
    "0": "", "1": "", "2": "operator new", "3": "operator delete", "4": "operator =", "5": "operator >>", "6": "operator <<", "7": "operator !",
    "8": "operator ==", "9": "operator !=", "A": "operator[]", "B": "", "C": "operator ->", "D": "operator *", "E": "operator ++", "F": "operator --",
    "G": "operator -", "H": "operator +", "I": "operator &", "J": "operator ->*", "K": "operator /", "L": "operator %", "M": "operator <",
    "N": "operator <=", "O": "operator >", "P": "operator >=", "Q": "operator,", "R": "operator ()", "S": "operator ~", "T": "operator ^",
    "U": "operator |", "V": "operator &&", "W": "operator ||", "X": "operator *=", "Y": "operator +=", "Z": "operator -=", "_0": "operator /=",
    "_1": "operator %=", "_2": "operator >>=", "_3": "operator <<=", "_4": "operator &=", "_5": "operator |=", "_6": "operator ^=",
    "_7": "", "_8": "", "_9": "", "_A": "", "_B": "", "_C": "", "_D": "", "_E": "", "_F": "", "_G": "", "_H": "", "_I": "", "_J": "", "_K": "",
    "_L": "", "_M": "", "_N": "", "_O": "", "_P": "", "_Q": "", "_R": "", "_S": "", "_T": "", "_U": "operator new[]", "_V": "operator delete[]",
    "_W": "", "_X": "", "_Y": "", "_Z": "", "__": "",
}

LEXEME = r"(?s)[A-Za-z0-9_\p{Nd}]+|::~|::|\\\\|."
# Names of the punctuation lexemes and keywords, which queries return.
PUNCTUATION = {
    "<": "LEFT_ANGLE", ">": "RIGHT_ANGLE", " ": "SPACE", "~": "TILDA", ".": "DOT", "(": "LEFT_PARENTH", ")": "RIGHT_PARENTH", ",": "COMMA",
    "=": "EQUALS", "+": "PLUS", "-": "HYPHEN", "*": "STAR", "/": "SLASH", "\\": "BACKSLASH", ":": "COLON", ";": "SEMICOLON", "!": "EXCLAMATION",
    "?": "QUESTION", "[": "LEFT_SQUARE", "]": "RIGHT_SQUARE", "&": "AND", "|": "PIPE", "%": "PERCENT", "^": "CARET", "'": "QUOTE", '"': "DQUOTE",
    "`": "BACKTICK", "@": "AT", "#": "HASH", "$": "DOLLAR", "{": "LEFT_CURLY", "}": "RIGHT_CURLY", "::": "SCOPE_RES", "::~": "DEST_SCOPE_RES",
    "\\\\": "DBACKSLASH", "operator": "OPERATOR", "new": "NEW", "delete": "DELETE",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escape_literal(c: Column) -> Column:
    """Control characters as two- to four-character escapes; backslashes doubled first."""
    for raw, escaped in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def decode_literal(raw: Column) -> Column:
    """Bytes as UTF-16LE text, or else UTF-8; null if both are empty."""
    return F.coalesce(F.nullif(F.decode(raw, "UTF-16LE"), F.lit("")), F.nullif(F.decode(raw, "UTF-8"), F.lit("")))


def lexemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LEXEME), F.lit(0))


def lexeme_type(lexeme: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PUNCTUATION.items() for x in pair])
    word = F.when(lexeme.rlike(r"^\p{Nd}"), "NUMBER_LIKE").when(lexeme.rlike("^[A-Za-z_]"), "IDENTIFIER_LIKE").otherwise("OTHER")
    return F.coalesce(F.try_element_at(names, lexeme), word)


def is_noise_symbol(name: Column) -> Column:
    return name.rlike("[`']|<lambda_|<unnamed-type-")


def demangle_plain(name: Column) -> Column:
    """An unmangled symbol's core: what stands before the first ``@`` or ``$``."""
    return F.regexp_extract(name, "^[^@$]*", 0)


def _qualified(rest: Column) -> tuple[Column, Column]:
    """(qualification, core) of ``core@inner@outer@...``; an unclosed last part is left out."""
    parts = F.split(F.regexp_extract(rest, r"^((?:[\p{L}\p{N}_]+@)+)", 1), "@")
    spaces = F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    return F.array_join(F.transform(spaces, lambda x: F.concat(x, F.lit("::"))), ""), F.get(parts, F.lit(0))


def demangle(name: Column) -> Column:
    """A mangled symbol's qualified core name; empty for ignored forms, null for unknown special codes."""
    def read(start: int) -> tuple[Column, Column]:
        return _qualified(F.substr(name, F.lit(start + 1)))

    codes = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    code = F.when(F.substring(name, 3, 1) == "_", F.substring(name, 3, 2)).otherwise(F.substring(name, 3, 1))
    after = F.length(code) + 3  # place of the character behind the code, from 1
    def special(start: Column) -> Column:
        qual, core = _qualified(F.substr(name, start))
        tail = F.when(code == "0", core).when(code == "1", F.concat(F.lit("~"), core)).otherwise(F.element_at(codes, code))
        return F.concat(qual, core, F.lit("::"), tail)
    known = F.map_contains_key(codes, code)
    ignored = (F.substr(name, after, F.lit(1)) == "@") | ((F.try_element_at(codes, code) == "") & ~code.isin("0", "1"))
    start = F.when(F.substr(name, after, F.lit(2)) == "?$", after + 2).otherwise(after)
    plain_q, plain_c = read(1)
    templ_q, templ_c = read(3)
    return (
        F.when(F.substring(name, 1, 4) == "??$?", "")
        .when(F.substring(name, 1, 3) == "??$", F.concat(templ_q, templ_c))
        .when((F.substring(name, 1, 2) == "??") & ~known, None)
        .when((F.substring(name, 1, 2) == "??") & ignored, "")
        .when(F.substring(name, 1, 2) == "??", special(start))
        .otherwise(F.concat(plain_q, plain_c))
    )


def loosely_contains(text: Column, token: Column) -> Column:
    """``text`` contains ``token`` with ASCII case ignored and ``_`` and ``%`` of the token as wildcards."""
    fold = lambda c: F.translate(c, UPPER, LOWER)
    # a backslash has no meaning in the pattern: the escape character is one that no literal holds
    pattern = F.concat(F.lit("%"), fold(token), F.lit("%"))
    return F.like(fold(text), pattern, F.lit("\uffff"))
