"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHOTO = r"(?i)\.(png|jpe?g)$"


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def parent_name(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")


def int_stem(path: Column) -> Column:
    """Text before the name's first dot as a number, underscores let through; null where it is none."""
    return F.replace(F.split_part(base(path), F.lit("."), F.lit(1)), F.lit("_"), F.lit("")).try_cast("int")


def sidecar(path: Column) -> Column:
    """The JSON beside a photo; the extension at the end only, whatever its case."""
    return F.regexp_replace(path, PHOTO, ".json")


def sidecar_anywhere(path: Column, extensions: tuple[str, ...] = (".png", ".jpg")) -> Column:
    """The extensions replaced wherever they stand, in the given order and in lower case only."""
    for e in extensions:
        path = F.replace(path, F.lit(e), F.lit(".json"))
    return path


def zero_padded(n: Column, width: int = 2) -> Column:
    return F.format_string(f"%0{width}d", n)


def variant_name(path: Column, variant: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), variant.cast("string"), F.lit(".png"))


def is_photo(path: Column, any_case: bool = True) -> Column:
    return F.rlike(path, F.lit(PHOTO if any_case else r"\.(png|jpe?g)$"))


def iso_seconds(time: Column | None = None) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, of now if no time is given."""
    return F.date_format(F.current_timestamp() if time is None else time, "yyyy-MM-dd'T'HH:mm:ss")


def status(idx: Column, total: Column, shots: Column) -> Column:
    """Place in a list, from 1 (0 in an empty one), its length, and how many shots the photo has."""
    return F.format_string("%d/%d | %d", F.when(total > 0, idx + 1).otherwise(0), total, shots)
