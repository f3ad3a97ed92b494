"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blattwerk import fixed


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case, with its dot; empty for none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^./]+$", "")


def file_kind(path: Column) -> Column:
    """``image``, ``pdf``, ``office`` or ``unsupported``."""
    ending = suffix(path)
    return (
        F.when(ending.isin(fixed.IMAGE_SUFFIXES), "image")
        .when(ending.isin(fixed.PDF_SUFFIXES), "pdf")
        .when(ending.isin(fixed.OFFICE_SUFFIXES), "office")
        .otherwise("unsupported")
    )


def path_order(path: Column) -> Column:
    """Sort key that compares paths folder by folder: ``a/b`` before ``a-b/c``."""
    return F.split(path, "/")
