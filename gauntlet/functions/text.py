"""String Column functions: newline handling, stripping, code extraction, excerpts.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen.  Python's ``\\s``/``\\w`` are Unicode-aware, hence the ``(?U)`` flag on
the Java patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the evaluated pipeline's) -------------------
NEWLINE_SURROGATE = "↵"
GOLD_SEPARATOR = "#" * 146
FAILED_STUB_PREFIX = "# generation failed"
PREVIEW_CHARS = 300
INSTRUCTION_PREVIEW_CHARS = 60
STDERR_EXCERPT_CHARS = 2000
OUTPUT_TAIL_CHARS = 2000
SNIPPET_CHARS = 120
FENCED_BLOCK = r"(?sU)```(?:python|py)?\s*\n(.*?)\n```"
OPENING_FENCE = r"(?U)\A```(?:python|py)?\s*\n?"
TRAILING_FENCE = r"(?s)\n?```.*\z"
# characters for which Python's str.isspace holds
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
# line breaks recognised by Python's str.splitlines
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# characters that Python's repr does not show as they are
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(c) -> Column:
    """Surrogate arrow, CRLF and lone CR all become LF (in that order)."""
    c = _c(c)
    c = F.replace(c, F.lit(NEWLINE_SURROGATE), F.lit("\n"))
    return F.regexp_replace(c, r"\r\n?", "\n")


def ustrip(c) -> Column:
    """Strip all white space that Python knows (``trim`` only removes spaces), in linear time."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def urstrip_newlines(c) -> Column:
    return F.rtrim(_c(c), F.lit("\n"))


def last_fenced_block(c) -> Column:
    """Body of the last fenced python/py/untagged block, or null."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(FENCED_BLOCK), F.lit(1)), F.lit(-1))


def unclosed_fallback(stripped) -> Column:
    """Drop an opening fence and everything from the first later fence."""
    c = F.regexp_replace(_c(stripped), OPENING_FENCE, "")
    c = F.regexp_replace(c, TRAILING_FENCE, "")
    return ustrip(c)


def extract_code(c) -> Column:
    """Code extraction = normalise, strip, last block, else fallback; plus LF."""
    s = ustrip(normalize_newlines(c))
    block = last_fenced_block(s)
    cand = unclosed_fallback(s)
    return (
        F.when(block.isNotNull(), F.concat(ustrip(block), F.lit("\n")))
        .when(cand != "", F.concat(cand, F.lit("\n")))
        .otherwise(F.concat(s, F.lit("\n")))
    )


def failed_stub(message) -> Column:
    """The placeholder written for a failed generation."""
    return F.concat(F.lit(FAILED_STUB_PREFIX + ": "), _c(message), F.lit("\n"))


def is_failed_stub(predict) -> Column:
    return F.startswith(F.ltrim(F.coalesce(_c(predict), F.lit("")), F.lit(WHITE_SPACE)), F.lit(FAILED_STUB_PREFIX))


def reply_preview(c) -> Column:
    """First 300 characters with LF shown as a pipe."""
    return F.replace(F.left(_c(c), F.lit(PREVIEW_CHARS)), F.lit("\n"), F.lit("|"))


def python_repr(c) -> Column:
    """The text of Python's ``repr`` of a string.

    Double quotes where it holds a single quote and no double one; the quote,
    backslash, tab and line breaks as backslash escapes; characters that
    Python does not print (controls, formats, separators other than the
    blank, unassigned) by their code point.
    """
    c = _c(c)
    quote = F.when(c.contains("'") & ~c.contains('"'), F.lit('"')).otherwise(F.lit("'"))

    def one(ch: Column) -> Column:
        number = F.ascii(ch)
        code = lambda mark, digits: F.concat(F.lit(mark), F.lpad(F.lower(F.hex(number)), digits, "0"))
        return (F.when((ch == "\\") | (ch == quote), F.concat(F.lit("\\"), ch))
                .when(ch == "\t", F.lit("\\t")).when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r"))
                .when(F.rlike(ch, F.lit(UNPRINTABLE)), F.when(number < 256, code("\\x", 2)).when(number < 65536, code("\\u", 4))
                      .otherwise(code("\\U", 8)))
                .otherwise(ch))

    characters = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    body = F.when(F.rlike(c, F.lit(r"[\\'\"]|" + UNPRINTABLE)), F.array_join(F.transform(characters, one), "")).otherwise(c)
    return F.concat(quote, body, quote)


def instruction_preview(c) -> Column:
    return F.left(_c(c), F.lit(INSTRUCTION_PREVIEW_CHARS))


def stderr_excerpt(c) -> Column:
    """Last 2000 characters, LF -> space; null reads as empty."""
    # ``replace`` searches bytes; ``translate`` would look up every character
    return F.replace(F.right(F.coalesce(_c(c), F.lit("")), F.lit(STDERR_EXCERPT_CHARS)), F.lit("\n"), F.lit(" "))


def outcome_snippet(stderr, stdout) -> Column:
    """Stderr, else stdout, else empty; first 120 characters, stripped."""
    txt = F.coalesce(F.nullif(_c(stderr), F.lit("")), F.nullif(_c(stdout), F.lit("")), F.lit(""))
    return ustrip(F.left(txt, F.lit(SNIPPET_CHARS)))


def splitlines(c) -> Column:
    """Python ``str.splitlines``: no trailing empty line, empty text -> []."""
    c = _c(c)
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def is_noise_line(c) -> Column:
    """A stderr line that is left out of the summary."""
    return _c(c).contains("ZeroDivisionError") | _c(c).contains("avg")


def drop_noise_lines(c) -> Column:
    """Lines without ``ZeroDivisionError`` or ``avg``, re-joined by LF; null if none."""
    kept = F.filter(splitlines(c), lambda x: ~is_noise_line(x))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def efficiency_summary(stdout, stderr) -> Column:
    """Stdout plus a ``[stderr]`` section when filtered stderr lines remain."""
    kept = drop_noise_lines(F.coalesce(_c(stderr), F.lit("")))
    return F.when(kept.isNotNull(), F.concat(_c(stdout), F.lit("\n[stderr]\n"), kept)).otherwise(_c(stdout))


def output_tail(c) -> Column:
    """Last 2000 characters."""
    return F.right(_c(c), F.lit(OUTPUT_TAIL_CHARS))


def gold_split(c):
    """(kernel, separator, test) around the first separator."""
    c = _c(c)
    pos = F.locate(GOLD_SEPARATOR, c)
    kernel = F.when(pos > 0, F.substring(c, F.lit(1), pos - 1)).otherwise(c)
    sep = F.when(pos > 0, F.lit(GOLD_SEPARATOR)).otherwise(F.lit(""))
    test = F.when(pos > 0, F.substring(c, pos + len(GOLD_SEPARATOR), F.lit(2147483647))).otherwise(F.lit(""))
    return kernel, sep, test


def strip_embedded_test(c) -> Column:
    """Text before the first separator, trailing LFs removed."""
    return urstrip_newlines(F.split_part(_c(c), F.lit(GOLD_SEPARATOR), F.lit(1)))


def assemble_test_module(code, test) -> Column:
    """Code, LF, separator, LF, test."""
    return F.concat(_c(code), F.lit("\n" + GOLD_SEPARATOR + "\n"), _c(test))


def sidecar_path(path) -> Column:
    """``x.jsonl`` -> ``x.gen_meta.json`` in the same folder."""
    path = _c(path)
    parent = F.regexp_extract(path, r"\A(.*/)?[^/]*\z", 1)
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"\.jsonl\z", "")
    return F.concat(parent, stem, F.lit(".gen_meta.json"))


def run_tag(model, dataset, limit, run) -> Column:
    """``{model with / and : as _}_{dataset}_limit{N or all}_{run}``."""
    lim = F.when(F.coalesce(_c(limit), F.lit(0)) == 0, F.lit("all")).otherwise(_c(limit).cast("string"))
    return F.concat_ws("_", F.translate(_c(model), "/:", "__"), _c(dataset),
                       F.concat(F.lit("limit"), lim), _c(run).cast("string"))
