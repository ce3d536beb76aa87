"""Path and formatting expressions, all as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def detected_os(path: Column) -> Column:
    """Windows for a drive path, else Linux."""
    return F.when(~F.startswith(path, F.lit("/")) & (F.substring(path, 2, 1) == ":"), "Windows").otherwise("Linux")


def join_path(base: Column, name: Column, os_name: Column | None = None) -> Column:
    """``name`` below ``base`` with the separator of the snapshot's system; an empty name adds nothing."""
    os_name = F.coalesce(os_name, detected_os(base)) if os_name is not None else detected_os(base)
    tail = F.regexp_replace(name, r"^[\\/]+", "")
    unix = F.replace(base, F.lit("\\"), F.lit("/"))
    unix = F.when(name == "", unix).otherwise(F.concat(F.rtrim(unix, F.lit("/")), F.lit("/"), tail))
    windows = F.replace(base, F.lit("/"), F.lit("\\"))
    windows = F.when(name == "", windows).otherwise(F.concat(F.rtrim(windows, F.lit("\\")), F.lit("\\"), tail))
    drive = F.when(F.length(name) == 2, F.concat(name, F.lit("\\"))).otherwise(F.replace(name, F.lit("/"), F.lit("\\")))
    windows = F.when((base == "/") & (F.substring(name, 2, 1) == ":"), drive).otherwise(windows)
    return F.when(os_name == "Windows", windows).otherwise(unix)


def to_native(path: Column, os_name: Column) -> Column:
    """A web path as the snapshot writes it: /C:/x and C:/x become C:\\x; other systems keep theirs."""
    bare = F.when(F.startswith(path, F.lit("/")) & (F.substring(path, 3, 1) == ":"), F.substring(path, 2, 1 << 30)).when(F.substring(path, 2, 1) == ":", path)
    native = F.regexp_replace(F.replace(bare, F.lit("/"), F.lit("\\")), r"\\+", r"\\")
    native = F.when(F.length(native) == 2, F.concat(native, F.lit("\\"))).otherwise(native)
    return F.when(os_name == "Windows", F.coalesce(native, path)).otherwise(path)


def to_web(path: Column, os_name: Column) -> Column:
    """C:\\ as /C: and C:\\x as /C:/x; other systems keep their paths."""
    drive = F.substring(path, 2, 1) == ":"
    web = F.when(F.endswith(path, F.lit(":\\")), F.concat(F.lit("/"), F.substring(path, 1, 1), F.lit(":"))).otherwise(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.when((os_name == "Windows") & drive, web).otherwise(path)


def prefixes(path: Column, os_name: Column) -> Column:
    """The path and all its ancestors but the bare root, shortest first."""
    sep = F.when(os_name == "Windows", "\\").otherwise("/")
    parts = F.when(os_name == "Windows", F.split(F.rtrim(path, F.lit("\\")), r"\\")).otherwise(F.split(F.rtrim(path, F.lit("/")), "/"))
    joined = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("array_join", F.slice(parts, F.lit(1), i), sep))
    named = F.transform(joined, lambda p: F.when((os_name == "Windows") & (F.length(p) == 2), F.concat(p, F.lit("\\"))).otherwise(p))
    return F.filter(named, lambda p: p != "")


def ancestors(path: Column, root: Column, os_name: Column) -> Column:
    """The path and its ancestors strictly below ``root``, shortest first; empty for the root itself."""
    sep = F.when(os_name == "Windows", "\\").otherwise("/")
    below = F.concat(F.rtrim(root, sep), sep)
    return F.filter(prefixes(path, os_name), lambda p: (F.length(p) > F.length(root)) & (F.startswith(p, below) | ((root == "/") & (os_name == "Windows"))))


def format_bytes(size: Column) -> Column:
    """Two decimals, rounded half to even, in units of 1024."""
    out = None
    for i, unit in enumerate(UNITS):
        value = F.bround(size.cast("double") / F.lit(float(1024**i)), 2)
        text = F.format_string(f"%.2f {unit}", value)
        fits = size < 1024 ** (i + 1)
        out = F.when(fits, text) if out is None else (out.when(fits, text) if i < len(UNITS) - 1 else out.otherwise(text))
    return F.when(size.isNotNull(), out)


def shortened(path: Column, most: int = 80) -> Column:
    """The last characters after "..." where a path has more than ``most``."""
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


def volume_name(index: Column) -> Column:
    return F.format_string("backup_%03d.zip", index)


def member_name(path: Column) -> Column:
    return F.ltrim(path, F.lit("/"))


def mac_address(number: Column) -> Column:
    """Six bytes of a 48-bit number, highest first."""
    digits = F.lower(F.lpad(F.hex(number), 12, "0"))
    return F.concat_ws(":", *[F.substring(digits, i, 2) for i in range(1, 13, 2)])


def thumbprint(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other; a null part is empty."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
