"""Text, path and question functions, all on the JVM side."""

from functools import reduce

from pyspark.sql import Column, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import fixed

# Fixed value: every character Python's str.strip() removes.
PY_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Fixed value: every character a browser's \s matches.
JS_SPACE = r"[\s\xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Fixed value: characters that are neither printable nor white space.
UNPRINTABLE = r"[\p{C}&&[^\t\n\x0b\f\r\x1c-\x1f\x85]]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{PY_SPACE}+", ""), f"{PY_SPACE}+$", "")


def contains_ignore_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def snippet(text: Column, size: int = DEFAULTS.source_snippet_chars) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def chip(text: Column, size: int = DEFAULTS.chip_chars) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, UNPRINTABLE, "")


def words(text: Column) -> Column:
    return F.split(F.lower(text), f"{JS_SPACE}+")


def keywords(query: Column) -> Column:
    """Words longer than two characters, repeats kept."""
    return F.filter(words(query), lambda w: F.length(w) > 2)


def question_status(question: Column) -> Column:
    length = F.length(strip(question))
    return (
        F.when(question.isNull() | (question == ""), "validation_failed")
        .when(length > DEFAULTS.question_max_chars, "question_too_long")
        .when(length < DEFAULTS.question_min_chars, "question_too_short")
        .otherwise("ok")
    )


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased ending with its dot, empty for names that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1))


def scheme(path: Column) -> Column:
    return F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def has_known_suffix(path: Column) -> Column:
    return suffix(path).isin(fixed.EXTENSIONS)


def safe_name(path: Column) -> Column:
    """Base name, or null where nothing usable is left."""
    name = base_name(F.regexp_replace(path, r"/+$", ""))
    return F.when(~name.isin("", ".", ".."), name)


def resolved_path(path: Column) -> Column:
    """Absolute path with '.', '..' and empty parts resolved."""
    def step(done, part):
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, part))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def path_under(path: Column, bases: list[str]) -> Column:
    """True for a resolved path equal to, or under, one of the bases; empty bases are skipped."""
    def under(base):
        base = base.rstrip("/")
        return (path == (base or "/")) | path.startswith(base + "/")

    return reduce(lambda a, b: a | b, [under(b) for b in bases if b], F.lit(False))


def source_or_unknown(source: Column) -> Column:
    return F.coalesce(source, F.lit("Unknown"))


def chat_line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(": "), text)


def contextual_question(context: Column, message: Column) -> Column:
    return F.when(
        F.length(context) > 0,
        F.concat(F.lit("Context: "), context, F.lit("\n\nQuestion: "), message),
    ).otherwise(message)


def client_identity(real_ip: Column, peer: Column) -> Column:
    header = F.when(F.length(real_ip) > 0, strip(real_ip))
    return F.coalesce(header, peer, F.lit("unknown"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def passage_id(text: Column, batch_ms: Column) -> Column:
    return F.concat(F.lit("doc_"), content_hash(text), F.lit("_"), batch_ms.cast("string"))


def error_label(error_class: Column) -> Column:
    pairs = [F.lit(v) for pair in fixed.ERROR_LABELS.items() for v in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), error_class), F.lit(fixed.DEFAULT_ERROR_LABEL))
