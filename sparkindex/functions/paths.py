"""Path expressions: suffix, language, ignored directories, import candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkindex.model import IGNORED, JS_LANGUAGES, JS_SUFFIXES, LANGUAGES


def suffix(path: Column) -> Column:
    """The lower-cased suffix of the file name; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix(path))


def is_ignored(path: Column) -> Column:
    """Whether a directory on the path is on the ignore list."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED]))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def normalized(path: Column) -> Column:
    """A relative path without `.`, empty and resolvable `..` parts; `.` if nothing is left."""

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    safe_last = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, part: _guarded(done, part, step))
    return F.when(F.size(safe_last) == 0, F.lit(".")).otherwise(F.array_join(safe_last, "/"))


def _guarded(done: Column, part: Column, step) -> Column:
    """element_at fails on an empty array, so that case is taken first."""
    first = F.when(part.isin("", "."), done).otherwise(F.array(part))
    return F.when(F.size(done) == 0, first).otherwise(step(done, part))


def _candidate(path: Column, name: Column) -> Column:
    return F.struct(path.alias("path"), name.alias("name"))


_NONE = "array<struct<path:string,name:string>>"


def python_candidates(target: Column, path: Column) -> Column:
    """Where the import of `target` in the file `path` may lead: (path, name), in order."""
    rest = F.ltrim(target, F.lit("."))
    dots = F.char_length(target) - F.char_length(rest)
    parts = F.split(rest, "\\.")
    above = F.split(path, "/")
    keep = F.greatest(F.size(above) - 1 - F.greatest(dots - 1, F.lit(0)), F.lit(0))
    prefix = F.when(dots > 0, F.filter(F.slice(above, F.lit(1), keep), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    module = F.array_join(F.concat(prefix, F.slice(parts, F.lit(1), F.size(parts) - 1)), "/")
    name = F.element_at(parts, -1)
    found = F.when(module != "", F.array(_candidate(F.concat(module, F.lit(".py")), name), _candidate(F.concat(module, F.lit("/__init__.py")), name))).otherwise(F.array(_candidate(F.lit("__init__.py"), name)))
    nothing = (rest == "") | ((dots == 0) & (F.size(parts) < 2))
    return F.when(nothing, F.array().cast(_NONE)).otherwise(found)


def js_candidates(target: Column, path: Column) -> Column:
    """The same for a `module:name` target of a JavaScript or TypeScript file."""
    name = F.element_at(F.split(target, ":"), -1)
    module = F.substring(target, F.lit(1), F.greatest(F.char_length(target) - F.char_length(name) - 1, F.lit(0)))
    base = normalized(F.array_join(F.concat(directories(path), F.array(module)), "/"))
    found = F.transform(F.array(*[F.lit(s) for s in JS_SUFFIXES]), lambda s: _candidate(F.concat(base, s), name))
    nothing = (module == "") | (name == "*") | ~module.startswith(".")
    return F.when(nothing, F.array().cast(_NONE)).otherwise(found)


def import_candidates(target: Column, language: Column, path: Column) -> Column:
    return F.when(language.isin(*JS_LANGUAGES), js_candidates(target, path)).otherwise(python_candidates(target, path))


def shared_directories(path: Column, other: Column) -> Column:
    """Leading directories that two paths share, as a share of the deeper one's."""
    a, b = directories(path), directories(other)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return shared / F.greatest(F.size(a), F.size(b), F.lit(1))
