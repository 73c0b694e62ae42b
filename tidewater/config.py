"""What the rules take as valid. Every value is a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # Code sets and bounds of the record format.
    genders: tuple[str, ...] = ("F", "M")
    ages: tuple[str, ...] = ("1", "18", "25", "35", "45", "50", "56")
    occupations: tuple[str, ...] = tuple(str(i) for i in range(21))
    genres: tuple[str, ...] = (
        "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
        "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
    )
    years: tuple[int, int] = (1880, 2010)
    ratings: tuple[int, int] = (1, 5)
    sentinel: str = "EXTRA_FIELD"
    ts_lo: int = 956_000_000
    ts_hi: int = 1_048_000_000
    ms_threshold: int = 10**12
    t1: int = 978_307_199
    t2: int = 1_009_843_199


#: For the records that the queries derive from the star schema; its orders run from 1995 to 2001.
STAR = Rules(ts_lo=788_918_400, ts_hi=1_009_843_199, ms_threshold=10**11, t1=915_148_799, t2=962_409_599)
