"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentlake.functions.text import ascii_lower

# File name extensions by class.
VIDEO_EXTENSIONS = ("mp4", "avi", "mkv", "wmv", "mov", "flv", "mpg", "mpeg", "m4v", "webm")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")


def path_prefix(path: Column) -> Column:
    """Everything before the last ``/``; NULL without one or when nothing stands before it."""
    size = F.length(path) - F.length(path_filename(path)) - 1
    return F.when(size > 0, F.substring(path, F.lit(1), size))


def path_filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(prefix: Column, filename: Column) -> Column:
    return F.coalesce(F.concat(prefix, F.lit("/"), filename), filename)


def extension(path: Column) -> Column:
    """Folded text after the last ``.`` of the whole path; NULL without a dot."""
    return F.when(F.contains(path, F.lit(".")), ascii_lower(F.substring_index(path, ".", -1)))


def is_video(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*VIDEO_EXTENSIONS), F.lit(False))


def is_image(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*IMAGE_EXTENSIONS), F.lit(False))


def extension_class(path: Column) -> Column:
    return F.when(is_video(path), "video").when(is_image(path), "image").otherwise("other")


def has_adjacent_digits(path: Column) -> Column:
    return F.regexp_like(path, F.lit("[0-9]{2}"))
