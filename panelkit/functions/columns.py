"""Column builders: coercion, cleaning, labels, ratios. All stay inside Spark's generated code; none is a Python UDF."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and what they are without accents.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŠšŽžČčĆćŘřĚěŮůŁłŃńŚśŹźŻżĄąĘęĞğİŞş"
UNACCENTED = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyySsZzCcCcRrEeUuLlNnSsZzZzAaEeGgISs"
# Country names that sources spell in two ways.
COUNTRY_ALIASES = {"south korea": "korea", "trinidad tobago": "trinidad and tobago", "guernsey": "guernsey states of", "jersey": "jersey states of", "macau": "macao"}
# Sectors and the parts of industry names that decide them, in the order in which they are tried.
SECTOR_WORDS = (
    ("Real Estate", "reit|real estate"),
    ("Financials", "bank|insurance|broker|financial"),
    ("Communication Services", "telecom|cable|broadcast|publishing|entertainment|information services|advertising"),
    ("Technology", "software|semiconductor|computer|electronics|internet|it services"),
    ("Health Care", "drug|health|hospital|medical|biotech|pharma"),
    ("Utilities", "utility|power"),
    ("Energy", "oil|gas|coal|energy"),
    ("Materials", "chemical|metals|mining|paper|forest|packaging|steel|precious"),
    ("Consumer Staples", "food|beverage|tobacco|household|grocery|consumer products"),
    ("Consumer Discretionary", "restaurant|retail|hotel|gaming|furn|apparel|auto|shoe|leisure|homebuild|building supply"),
)
# region's action, sector's action, and what both together ask for.
COMBINED_ACTIONS = (
    ("underweight", "overweight", "relative_overweight"), ("underweight", "market_weight", "underweight"), ("underweight", "underweight", "high_conviction_underweight"),
    ("neutral", "overweight", "overweight"), ("neutral", "market_weight", "market_weight"), ("neutral", "underweight", "underweight"),
    ("overweight", "overweight", "high_conviction_overweight"), ("overweight", "market_weight", "overweight"), ("overweight", "underweight", "relative_underweight"),
)
# Scores and multipliers of labels.
SIGNAL_SCORES = {"high_conviction_underweight": -1.0, "underweight": -0.6, "relative_underweight": -0.3, "market_weight": 0.0, "neutral": 0.0, "relative_overweight": 0.3, "overweight": 0.6, "high_conviction_overweight": 1.0}
REGION_MULTIPLIERS = {"underweight": 0.75, "neutral": 1.00, "overweight": 1.20}
ACTION_MULTIPLIERS = {"high_conviction_underweight": 0.55, "underweight": 0.75, "relative_underweight": 0.90, "market_weight": 1.00, "relative_overweight": 1.15, "overweight": 1.30, "high_conviction_overweight": 1.45}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM", "MMM yyyy")
#: Free forms, tried after those: month first, then day first. Signs between the parts are single spaces by then.
MONTH_FIRST = ("MMM d yyyy", "MMMM d yyyy", "M d yyyy", "M d yy", "yyyy MMM d", "yyyy M d")
DAY_FIRST = ("d MMM yyyy", "d MMMM yyyy", "d M yyyy", "d MMM yy", "d M yy")
#: Statuses that count as solved.
FEASIBLE = ("optimal", "optimal_inaccurate", "feasible")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """A finite double; null for bad text, NaN and infinities."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number_token(c: str | Column) -> Column:
    """`1.234,5`, `1,234.5`, `12,5`, `USD 12.5`: commas beside dots are thousands, alone they are the decimal point."""
    x = F.regexp_replace(F.upper(col(c)), "[\\s ]|N/A", "")
    x = F.when(x.contains(",") & x.contains("."), F.regexp_replace(x, ",", "")).otherwise(F.regexp_replace(x, ",", "."))
    return to_number(F.regexp_replace(x, r"[^0-9.+\-E]|E(?![+\-]?[0-9])", ""))


def date_token(c: str | Column) -> Column:
    """The first format that fits, then free forms, month first before day first; `Dec-86` is in the last century from 69 on."""
    x = F.trim(col(c))
    short = F.try_to_timestamp(F.concat_ws("-", F.initcap(F.substring_index(x, "-", 1)), F.concat(F.when(F.substring_index(x, "-", -1).try_cast("int") >= 69, "19").otherwise("20"), F.substring_index(x, "-", -1))), F.lit("MMM-yyyy"))
    free = F.initcap(F.trim(F.regexp_replace(x, r"[\s,./\-]+", " ")))
    found = [F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS] + [F.try_to_timestamp(free, F.lit(f)) for f in (*MONTH_FIRST, *DAY_FIRST)]
    return F.to_date(F.when(x.rlike("^[A-Za-z]{3}-[0-9]{2}$"), short).otherwise(F.coalesce(*found)))


def label_key(c: str | Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9]", ""))


def country_key(c: str | Column, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """C4: plain lower-case words, one name for each country."""
    x = F.lower(F.translate(col(c), ACCENTED, UNACCENTED))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "&", " and "), "[^a-z0-9]+", " "))
    return label_value(x, aliases, x)


def name_key(c: str | Column) -> Column:
    """C4: a name's words as a string that equals others by their letters alone (collation UNICODE_CI_AI): case, accents, combining
    marks, ligatures and full-width forms make no difference in joins and groups on it."""
    words = F.regexp_replace(F.regexp_replace(col(c), "[&\uFF06]", " and "), r"[^\p{L}\p{N}\p{M}]+", " ")
    return F.collate(F.trim(words), "UNICODE_CI_AI")


def label_value(c: str | Column, values: Mapping[str, object], default) -> Column:
    """The value of a label, the default for others and for null."""
    pairs = F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, col(c)), default if isinstance(default, Column) else F.lit(default))


def sector_of(c: str | Column, words: Sequence[tuple[str, str]] = SECTOR_WORDS, default: str = "Industrials") -> Column:
    """The first sector one of whose words is in the name."""
    name = F.lower(col(c))
    return F.coalesce(*(F.when(name.rlike(pattern), F.lit(sector)) for sector, pattern in words), F.lit(default))


def combine_actions(region: str | Column, sector: str | Column) -> Column:
    """C7."""
    return label_value(F.concat_ws("|", col(region), col(sector)), {f"{r}|{s}": both for r, s, both in COMBINED_ACTIONS}, "market_weight")


def decimal_month(c: str | Column) -> Column:
    """1871.01 is January 1871; null outside months 1 to 12."""
    year = F.floor(col(c))
    month = F.rint((col(c) - year) * 100).cast("int")
    return F.when(month.between(1, 12), F.make_date(year.cast("int"), month, F.lit(1)))


def ticker(c: str | Column, suffix: str = "") -> Column:
    """C10."""
    return F.concat(F.lower(F.regexp_replace(F.trim(col(c)), r"\.", "-")), F.lit(suffix))


def ticker_list(c: str | Column) -> Column:
    """The parts between commas, trimmed and in capitals; empty ones are left out."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def case_number(c: str | Column) -> Column:
    """N of `Case n`; null without one."""
    return F.regexp_extract(col(c), r"Case\s+([0-9]+)", 1).try_cast("int")


def industry_name(c: str | Column) -> Column:
    """The trimmed name; null for blank ones, `nan` and the rows of market totals."""
    name = F.trim(col(c))
    low = F.lower(name)
    return F.when((name != "") & (low != "nan") & ~low.startswith("total market"), name)


def feasible(status: str | Column, statuses: Sequence[str] = FEASIBLE) -> Column:
    """Whether a solver's status counts as solved; a null doesn't."""
    return F.coalesce(F.lower(col(status)).isin(*statuses), F.lit(False))


def exposure_vector(exposures: str | Column, tickers: Sequence[str]) -> Column:
    """C17: the map's values in the order of tickers, 0 where it has none; null if it has a key that isn't one of them."""
    known = F.array(*map(F.lit, tickers))
    unknown = F.size(F.array_except(F.map_keys(col(exposures)), known)) > 0
    return F.when(~unknown, F.transform(known, lambda t: F.coalesce(F.try_element_at(col(exposures), t).cast("double"), F.lit(0.0))))


def padded_start(start: str | Column, months: int = 2) -> Column:
    """A start two months earlier, so that the first row kept has one before it."""
    return F.add_months(F.to_date(F.lit(start) if isinstance(start, str) else start), -months)


def sample_of(date: str | Column, split: str) -> Column:
    """`in` before the split, `out` from it on."""
    return F.when(col(date) < F.to_date(F.lit(split)), "in").otherwise("out")


def ratio(a: str | Column, b: str | Column) -> Column:
    """C11: null where the divisor is 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def near(c: str | Column, value: str | Column | float) -> Column:
    """C14: equal within floating-point tolerance."""
    v = value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))
    return F.abs(col(c) - v) <= 1e-8 + 1e-5 * F.abs(v)


def exposures_text(c: str | Column) -> Column:
    """`A:+1.00; B:-1.00`, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(c))), lambda e: F.format_string("%s:%+.2f", e["key"], e["value"])), "; ")


def annualise(total: str | Column, months: str | Column | float) -> Column:
    """Yearly rate of a simple return over a number of months."""
    m = months if isinstance(months, Column) else F.col(months) if isinstance(months, str) else F.lit(float(months))
    return F.pow(1 + col(total), 12.0 / m) - 1


def row_mean(*columns: str | Column) -> Column:
    """C20: mean of what isn't null."""
    present = functools.reduce(operator.add, (col(c).isNotNull().cast("int") for c in columns))
    return F.when(present > 0, functools.reduce(operator.add, (F.coalesce(col(c), F.lit(0.0)) for c in columns)) / present)


def grid(start: float, end: float, step: float) -> Column:
    """An inclusive grid; integers are counted, so nothing drifts."""
    return F.transform(F.sequence(F.lit(0), F.lit(round((end - start) / step))), lambda i: F.round(F.lit(start) + i * step, 10))


def sample_skew(c: str | Column) -> Column:
    """Bias-corrected; null below three values."""
    n = F.count(col(c))
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(col(c))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)) + 6))
