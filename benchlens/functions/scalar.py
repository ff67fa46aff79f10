"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and patterns of the text the study tools read and write.
TS_PATH_FORMAT = "yyyy-MM-dd-HH:mm:ss"
PKG_ID_PATTERN = r"^(.*)-([0-9]+(?:[.][0-9]+)*)$"
ERROR_LINE_PATTERN = r"^ERROR: (.*) returned exit code (-?[0-9]+)$"
DURATION_PATTERN = r"^([0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?) ?(ns|us|ms|s)$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    """Last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def drop_extension(name: Column | str) -> Column:
    """Name without its last extension (``a.b.csv`` -> ``a.b``; a leading dot is not an extension)."""
    return F.regexp_replace(_c(name), r"(?<=.)\.[^./]*$", "")


def extension(name: Column | str) -> Column:
    """Last extension with its dot, or empty."""
    return F.regexp_extract(_c(name), r"(?<=.)(\.[^./]*)$", 1)


def path_join(*parts: Column | str) -> Column:
    """``a </> b``: join with '/', an empty part is left out."""
    return F.concat_ws("/", *[F.nullif(_c(p), F.lit("")) for p in parts])


def target_slug_nightly(day: Column | str) -> Column:
    """``nightly-YYYY-MM-DD``."""
    return F.concat(F.lit("nightly-"), F.date_format(_c(day), "yyyy-MM-dd"))


def target_slug_lts(major: Column | str, minor: Column | str) -> Column:
    """``lts-X.Y``."""
    return F.format_string("lts-%d.%d", _c(major), _c(minor))


def pkg_id(name: Column | str, version: Column | str) -> Column:
    """``name-version``."""
    return F.concat_ws("-", _c(name), _c(version))


def pkg_name(pid: Column | str) -> Column:
    """Package name of ``name-version`` (names may contain dashes)."""
    return F.nullif(F.regexp_extract(_c(pid), PKG_ID_PATTERN, 1), F.lit(""))


def pkg_version(pid: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(pid), PKG_ID_PATTERN, 2), F.lit(""))


def ts_path_text(ts: Column | str) -> Column:
    """Run timestamp as it appears in result paths."""
    return F.date_format(_c(ts), TS_PATH_FORMAT)


def error_line(cmd: Column | str, code: Column | str) -> Column:
    """``ERROR: <cmd> returned exit code <n>``."""
    return F.concat(F.lit("ERROR: "), _c(cmd), F.lit(" returned exit code "), _c(code).cast("string"))


def error_cmd(line: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(line), ERROR_LINE_PATTERN, 1), F.lit(""))


def error_code(line: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(line), ERROR_LINE_PATTERN, 2), F.lit("")).cast("int")


def duration_text(seconds: Column | str) -> Column:
    """Seconds as '<number> <unit>' with the unit chosen by magnitude (s, ms, us, ns).

    The number is rounded half-to-even to 3 decimals before formatting, so the
    text does not depend on how a formatter rounds decimal ties.
    """
    s = _c(seconds)

    def fmt(v: Column, unit: str) -> Column:
        return F.format_string("%.3f " + unit, round_half_even(v, 3))

    return (F.when(s >= 1, fmt(s, "s")).when(s >= 1e-3, fmt(s * 1e3, "ms"))
            .when(s >= 1e-6, fmt(s * 1e6, "us")).otherwise(fmt(s * 1e9, "ns")))


def duration_seconds(text: Column | str) -> Column:
    """Inverse of ``duration_text`` (also reads text without the space)."""
    t = F.trim(_c(text))
    num = F.regexp_extract(t, DURATION_PATTERN, 1)
    unit = F.regexp_extract(t, DURATION_PATTERN, 2)
    scale = (F.when(unit == "s", 1.0).when(unit == "ms", 1e-3).when(unit == "us", 1e-6)
             .when(unit == "ns", 1e-9))
    return F.nullif(num, F.lit("")).try_cast("double") * scale


def round_half_even(x: Column | str, places: int) -> Column:
    """Half-to-even rounding of doubles to ``places`` decimals."""
    k = float(10 ** places)
    return F.rint(_c(x) * F.lit(k)) / F.lit(k)


# Characters whose upper-case form is several characters (a rule, not a list): they stay as they are.
_GROWING = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1)
_STAND_IN = "".join(chr(0xE000 + i) for i in range(len(_GROWING)))


def upper_chars(text: Column | str) -> Column:
    """Upper case character by character, so the length never changes.

    Characters that would grow are set aside as private-use characters; a text
    that holds such characters itself is cut at the growing ones instead.
    """
    t = _c(text)
    apart = F.translate(F.upper(F.translate(t, _GROWING, _STAND_IN)), _STAND_IN, _GROWING)
    cut = F.regexp_extract_all(t, F.lit(f"[{_GROWING}]|[^{_GROWING}]+"), F.lit(0))
    kept = F.transform(cut, lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x))
    return (F.when(F.octet_length(t) == F.length(t), F.upper(t))  # ASCII
            .when(t.rlike(f"[{_STAND_IN[0]}-{_STAND_IN[-1]}]"), F.array_join(kept, "")).otherwise(apart))
