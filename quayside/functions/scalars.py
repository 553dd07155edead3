"""Column functions: bands, ordered keyword rules, curves, and text that is put in one form."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.config import DRAWDOWN_POINTS, FIT_ANCHORS, VOLATILITY_BANDS


def half_up(x: Column | str, digits: int) -> Column:
    """A double rounded half up (away from zero) at digits, after binary noise below 1e-10 is gone; NaN and what is too large give null.

    round() of a double looks at its shortest text, other engines at its
    binary value; on decimals all agree.
    """
    return F.round((F.col(x) if isinstance(x, str) else x).try_cast("decimal(28,10)"), digits).cast("double")


def number(text: Column) -> Column:
    """Text to double; what is no number is null."""
    return F.trim(text.cast("string")).try_cast("double")


def band_up_to(x: Column, bands: Sequence[tuple[float | None, object]] = VOLATILITY_BANDS) -> Column:
    """The label of the first band whose upper limit isn't below x; None has no limit. Null gives null."""
    out = F.lit(None)
    for limit, label in reversed(bands):
        out = F.lit(label) if limit is None else F.when(x <= limit, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def band_from(x: Column, bands: Sequence[tuple[float | None, object]] = DRAWDOWN_POINTS) -> Column:
    """The value of the first band whose lower limit isn't above x."""
    out = F.lit(None)
    for limit, value in reversed(bands):
        out = F.lit(value) if limit is None else F.when(x >= limit, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def first_rule(text: Column, rules: Iterable[tuple[Sequence[str], object]], default: object = None) -> Column:
    """The value of the first rule one of whose keywords is in text (upper case compared); the order of rules matters."""
    upper, out = F.upper(F.coalesce(text, F.lit(""))), F.lit(default)
    for words, value in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | upper.contains(w.upper())
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


# Labels and keywords, in the order in which they are tried.
FUND_TYPES = (
    (("fund-of-funds", "fund of funds"), "Fund of Funds"),
    (("money market",), "Money Market"),
    (("bond", "sukuk", "fixed income"), "Fixed Income"),
    (("mixed asset", "balanced"), "Mixed Asset / Balanced"),
    (("equity",), "Equity"),
)
DISTRIBUTION = ((("no distribution",), "None"), (("semi-annual", "semi annual"), "Semi-Annual"), (("monthly",), "Monthly"), (("annual",), "Annual"), (("incidental",), "Incidental"))
PLACES = (
    (("malaysia", "domestic", "klci"), "Malaysia"),
    (("china",), "Greater China"),
    (("asean", "southeast asia", "south-east asia"), "ASEAN"),
    (("asia pacific", "far-east", "far east"), "Asia Pacific"),
    (("asia",), "Asia"),
    (("us ", "u.s.", "america", "nasdaq"), "United States"),
    (("global", "worldwide"), "Global"),
    (("indonesia",), "Indonesia"),
    (("india",), "India"),
    (("japan",), "Japan"),
    (("australia",), "Australia"),
    (("vietnam",), "Vietnam"),
    (("singapore",), "Singapore"),
)
HOME = "Malaysia"
HOME_MARKS = ("malaysia", "myr", "domestic")
FOREIGN_MARKS = ("asia", "china", "global", "asean", "pacific", "india", "indonesia", "japan", "australia", "vietnam", "singapore", "europe", "emerging", "far east", "united states")
TRUE_WORDS = ("yes", "y", "true", "shariah", "shariah-compliant")


def fund_type(category: Column) -> Column:
    """Type of a stated category; a wholesale fund counts by whether it holds money. Unknown is empty."""
    low = F.lower(F.coalesce(category, F.lit("")))
    return F.coalesce(first_rule(category, FUND_TYPES), F.when(low.contains("wholesale") & low.contains("money"), "Money Market"), F.lit(""))


def fund_type_or(stated: Column, asset: Column) -> Column:
    """The stated type, else that of the asset class, else Equity."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(fund_type(asset), F.lit("")), F.lit("Equity"))


def distribution(policy: Column) -> Column:
    return F.coalesce(first_rule(policy, DISTRIBUTION), F.lit("None"))


def place_of(name: Column, places: Iterable[tuple[Sequence[str], object]] = PLACES, home: str = HOME) -> Column:
    return first_rule(name, places, home)


def asset_class(name: Column, label: Column) -> Column:
    """Asset class of a fund's name and its peer group's label: cash first, then bonds of Islamic law, mixed kinds, other bonds, equity by place."""
    n, c = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(label, F.lit("")))
    some = lambda text, words: text.rlike("|".join(words))
    bonds, equity = "Bond / Fixed Income", some(n, ["EQUITY"]) | some(c, ["EQUITY"])
    return (
        F.when(some(n, ["MONEY MARKET", "CASH DEPOSIT", "CASH MANAGEMENT"]), "Money Market")
        .when(some(n, ["SUKUK"]) | some(c, ["SUKUK"]), "Bond / Sukuk")
        .when(some(n, ["BALANCED"]), "Balanced")
        .when(some(c, ["MIXED ASSET"]) | some(n, ["MIXED", "ALLOCATION", "FLEXI"]), "Mixed Asset")
        .when(some(n, ["BOND", "FIXED INCOME"]) | (some(n, ["INCOME"]) & (some(c, ["BOND"]) | ~some(c, ["EQUITY"]))), bonds)
        .when(equity & (some(c, ["MALAYSIA"]) | some(n, ["MALAYSIA", "DOMESTIC"])), "Equity - Malaysia")
        .when(equity, "Equity - Foreign")
        .when(some(c, ["BOND", "FIXED"]), bonds)
        .otherwise("Other")
    )


def series_flag(file: Column, name: Column, code: Column, stated: Column | None = None, prefixes: Sequence[str] = ()) -> Column:
    """Whether a fund is of the screened series: as stated, else by its file, name or code's prefix (a caller's table)."""
    found = F.lower(file).contains("shariah") | F.contains(name, F.lit("Islamic"))
    for p in prefixes:
        found = found | F.startswith(code, F.lit(p))
    return F.coalesce(found, F.lit(False)) if stated is None else F.coalesce(stated, found, F.lit(False))


def structural_role(code: Column, roles: dict[str, str] | None = None) -> Column:
    """The role that a code has by itself, else core; roles is the caller's table of codes."""
    out = F.lit("core")
    for c, role in (roles or {}).items():
        out = F.when(code == c, role).otherwise(out)
    return out


def holding_label(role: Column, derived: Column, kind: Column) -> Column:
    """What a holding counts as: by its sleeve, else by its derived class, else by its type."""
    by_role = F.when(role == "structural:gold", "gold").when(role == "structural:money_market", "MM")
    by_class = F.when(derived == "Equity-equivalent", "equity").when(derived == "Defensive", "bond").when(derived == "Balanced", "balanced")
    by_kind = F.when(F.lower(F.coalesce(kind, F.lit(""))).rlike(r"bond|fixed\s*income|sukuk"), "bond").otherwise("equity")
    return F.coalesce(by_role, by_class, by_kind)


def output_name(client: Column, risk: Column, day: Column, version: Column) -> Column:
    """FundProposal_<name or generic>_<Risk>_<date>_v<version>; the day is given, so a name can be made again."""
    return F.concat(F.lit("FundProposal_"), file_part(client), F.lit("_"), F.replace(risk, F.lit(" "), F.lit("")), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_v"), version)


def objective_class(text: Column) -> Column:
    """Growth, income or both from an objective's words; liquidity speaks for income, commodities for growth; else empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    growth, income = low.rlike("capital growth|growth of capital|capital appreciation"), low.rlike("income|dividend|yield")
    both = low.rlike("growth and income|income and|combination of|growth & income")
    return (
        F.when(both | (growth & income), "Capital Growth + Income")
        .when(income, "Income")
        .when(growth, "Capital Growth")
        .when(low.rlike("liquidity|capital stability|preserve"), "Income")
        .when(low.rlike("gold|commodity|price of|exposure to"), "Capital Growth")
        .otherwise("")
    )


def truthy(x: Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    """Whether text says yes; null is no."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*words), F.lit(False))


def derived_class(equity: Column, fixed: Column, cash: Column, deposits: Column, least: float = 60.0) -> Column:
    """Equity first, then the defensive shares together, else Balanced; a null share counts as nothing."""
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(share(equity) >= least, "Equity-equivalent").when(share(fixed) + share(cash) + share(deposits) >= least, "Defensive").otherwise("Balanced")


def recovery_points(days: Column) -> Column:
    """What the days since the all-time high add; null adds nothing."""
    return F.when(days.isNull(), 0.0).when(days < 30, 15.0).when(days <= 90, 10.0).when(days <= 180, 5.0).when(days <= 365, 0.0).otherwise(-10.0)


def momentum(drawdown: Column, days: Column) -> Column:
    """Points of the drawdown (null: -50) and of the recovery, from 0 to 100."""
    points = band_from(F.coalesce(drawdown, F.lit(-50.0))) + recovery_points(days)
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0))


def piecewise(x: Column, anchors: Sequence[tuple[float, float]] = FIT_ANCHORS, digits: int = 1) -> Column:
    """Straight lines between anchors, level beyond the first and the last."""
    out = F.when(x <= anchors[0][0], F.lit(anchors[0][1]))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(x < x1, half_up(y0 + (x - x0) / (x1 - x0) * (y1 - y0), digits))
    return F.when(x.isNotNull(), out.otherwise(F.lit(anchors[-1][1])))


def key_form(text: Column) -> Column:
    """Upper case without spaces, for keys that are written in several ways."""
    return F.upper(F.replace(text, F.lit(" "), F.lit("")))


def clean_name(text: Column, phrases: Sequence[str] = ()) -> Column:
    """text without some phrases, blanks run together, control characters gone."""
    out = text
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"[\x00-\x1F\x7F]", ""))


def person_name(text: Column, most: int = 100) -> Column:
    return F.left(clean_name(F.coalesce(text, F.lit(""))), F.lit(most))


def file_part(name: Column, default: str = "generic") -> Column:
    """Letters and digits of any script only; an empty rest gives the default."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit(default))


def shown(x: Column, digits: int = 2) -> Column:
    """A number as text with fixed digits; null as an empty text. For text sinks only."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise("")


def event_date(text: Column) -> Column:
    """An ISO date as '05 Jan 2024'; any other text as it is."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.coalesce(F.date_format(F.to_date(iso.try_cast("date")), "dd MMM yyyy"), text)


def foreign_region(label: Column, home: Sequence[str], foreign: Sequence[str]) -> Column:
    """Whether a label names a foreign region and not home; an empty one doesn't."""
    text = F.lower(F.coalesce(label, F.lit("")))
    names = lambda words: text.rlike("|".join(w.lower() for w in words))
    return (text != "") & ~names(home) & names(foreign)


def pair_list(text: Column) -> Column:
    """'a=1|b=2' as a map; of a key's values the last counts, and what has no '=' is passed over."""
    pairs = F.filter(F.split(text, r"\|"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p, i: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.trim(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")))
    # sorted by key and place, a key's last entry is the one before another key; the list is bound to a name, so it is sorted once
    last = F.transform(F.array(F.array_sort(entries)), lambda all: F.filter(all, lambda e, i: F.coalesce(F.get(all, i + 1)["k"] != e["k"], F.lit(True))))
    return F.map_from_entries(F.transform(F.get(last, 0), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))


def split_list(text: Column, mark: str = r"\|") -> Column:
    """Trimmed parts that aren't empty; null gives null."""
    return F.filter(F.transform(F.split(text, mark), lambda p: F.trim(p)), lambda p: p != "")
