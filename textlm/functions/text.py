"""Column expressions for lines and tokens (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# TOKEN_PATTERN: a token is a run of word characters (letters, numbers of any
#   kind, underscore) or one of  , . " - : ? ) ( – ; !   where the pair
#   "-: is a character range U+0022..U+003A (so # $ % & ' * + - / and the
#   digits are inside, < = > @ [ ] { } « » — are outside).
# EOL_TOKEN: the word appended to every stripped line.
# LINE_BREAK: text-mode line iteration splits on LF, CRLF and CR.
# WHITESPACE: the characters str.split() splits on (tab, LF, VT, FF, CR,
#   U+001C..U+001F, space, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
#   U+2029, U+202F, U+205F, U+3000), written so Java and RE2 read it alike.
# ---------------------------------------------------------------------------
TOKEN_PATTERN = r'[\p{L}\p{N}_,."-:?)(–;!]+'
EOL_TOKEN = "endofline"
LINE_BREAK = r"\r\n|\r|\n"
WHITESPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def with_eol(line: Column) -> Column:
    """``strip(line) + ' endofline'`` (B2)."""
    return F.concat(F.trim(line), F.lit(" " + EOL_TOKEN))


def tokenize(text: Column) -> Column:
    """All regex matches of the token class, case kept (B1)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def line_tokens(line: Column) -> Column:
    """Tokens of one line with the end-of-line word (B1 over B2)."""
    return tokenize(with_eol(line))


def ws_tokens(line: Column) -> Column:
    """Whitespace split with empty pieces removed."""
    return F.filter(F.split(line, WHITESPACE), lambda x: x != F.lit(""))


def reverse_tokens(tokens: Column) -> Column:
    """Token order reversed."""
    return F.reverse(tokens)


def split_lines(text: Column) -> Column:
    """Lines of a text; a final empty piece (trailing newline) is not a line."""
    return whole_lines(line_pieces(text))


def line_pieces(text: Column) -> Column:
    """The text cut at ``LINE_BREAK``: the breaks are made one character first, as no pattern is run to cut at that."""
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(lf, "\n")


def whole_lines(pieces: Column) -> Column:
    """``line_pieces`` without a final empty one.  A generator evaluates its input anew at every mention: give it
    the pieces as a column of an earlier select, and each text is split once."""
    return F.when(
        F.element_at(pieces, -1) == F.lit(""), F.slice(pieces, 1, F.size(pieces) - 1)
    ).otherwise(pieces)
