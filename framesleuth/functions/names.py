"""Media titles from release names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that end a title in a release name, and names a file may not have.
RELEASE_TOKENS = (
    r"480[pi]|576[pi]|720p|1080[pi]|2160p|4320p|WEB[ -]?DL|WEBRip|Blu[ -]?Ray|BDRip|HDTV|REMUX|x26[45]|H[ .]?26[45]|HEVC|AV1|AMZN|DDP"
)
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)))
# Where a title ends, how episodes are written, and endings of media and companion files.
BOUNDARY = r"(?is)^(.*?)(?:^|[\s\[(-])(?:" + RELEASE_TOKENS + r")(?=$|[\s\].)-])"
EPISODE = r"(?i)\bS\d{1,3}E\d{1,3}(?:E\d{1,3})*\b"
MEDIA_EXTENSIONS = (
    ".3gp", ".avi", ".flv", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".ts", ".webm", ".wmv",
)
COMPANION_EXTENSIONS = (".srt", ".ass", ".ssa", ".sub", ".idx", ".vtt", ".nfo", ".jpg", ".png")


def _strip(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def clean_title(stem: Column, this_year: int, suffix: str = ".mkv") -> Column:
    """Title without release suffixes; NULL when no safe title remains.

    An episode number is kept upper-cased between title and remainder;
    otherwise a trailing year becomes ``(year)`` unless it lies in the future.
    """
    name = F.trim(F.regexp_replace(stem, r"[._]+", " "))
    cut = _strip(F.regexp_extract(name, BOUNDARY, 1), " -([.")
    name = F.when(name.rlike(BOUNDARY), cut).otherwise(name)
    number = F.regexp_extract(name, EPISODE, 0)
    before = _strip(F.regexp_extract(name, r"(?is)^(.*?)" + EPISODE[4:], 1), " -")
    after = _strip(F.regexp_extract(name, r"(?is)^.*?" + EPISODE[4:] + r"(.*)$", 1), " -")
    episode = F.concat(before, F.lit(" - "), F.upper(number), F.when(after != "", F.concat(F.lit(" - "), after)).otherwise(""))
    bracketed, bare = r"^(.*)\(((?:19|20)\d{2})\)$", r"^(.*?)(?<!\d)((?:19|20)\d{2})$"
    pattern_year = F.when(name.rlike(bracketed), F.regexp_extract(name, bracketed, 2)).otherwise(F.regexp_extract(name, bare, 2))
    head = _strip(F.when(name.rlike(bracketed), F.regexp_extract(name, bracketed, 1)).otherwise(F.regexp_extract(name, bare, 1)), " (")
    future = ~name.rlike(bracketed) & (pattern_year.try_cast("int") > this_year + 1)
    dated = F.when((pattern_year != "") & ~F.coalesce(future, F.lit(False)) & (head != ""), F.concat(head, F.lit(" ("), pattern_year, F.lit(")"))).otherwise(name)
    named = F.when(number != "", episode).otherwise(dated)
    named = _strip(F.regexp_replace(F.regexp_replace(named, r'[<>:"/\\|?*]', " "), r"\s+", " "), " .-")
    return F.when((named != "") & ~F.upper(named).isin(*RESERVED_NAMES), F.concat(named, F.lit(suffix)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*[^/.][^/]*?(\.[^./]+)$", 1))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]+)?$", 1)
