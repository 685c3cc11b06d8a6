"""Labels to categories by ordered rules: the first that matches decides. Rules are data, and become one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions and the categories that they stand for, in order of precedence.
#: Visa subclasses, by number or by words.
SUBCLASS_RULES = [
    (r"^(500|570|571|572|573|574|575|576|580|590)\b|(?i)student", "student"),
    (r"^(186|187|189|190|191|482|457|494|491|858)\b|(?i)skilled|employer.?sponsored|global talent|business innovation", "skilled"),
    (r"^(417|462)\b|(?i)working holiday", "working_holiday"),
    (r"^(100|101|102|103|114|115|116|117|143|151|173|300|309|310|801|802|820|826|832|835|836|837|838|864|884)\b|(?i)family|partner|parent|child", "family"),
    (r"^444\b|(?i)new zealand", "nz_citizen"),
    (r"^(010|020|030|040|041|050|051|060|070)\b|(?i)bridging", "bridging"),
    (r"(?i)permanent", "permanent"),
    (r"^(400|403|408|476|485|488|600|601|602|651|771|785|790|866)\b|(?i)temporary", "other_temp"),
    (r"(?i)australian citizen", "returning_au"),
    (r".*", "other"),
]
#: Column heads of movement tables; a total has no category.
VISA_GROUP_RULES = [
    (r"(?i)444|special category", "nz_citizen"),
    (r"(?i)student", "student"),
    (r"(?i)skill", "skilled"),
    (r"(?i)working", "working_holiday"),
    (r"(?i)family|partner", "family"),
    (r"(?i)new\s*zealand", "nz_citizen"),
    (r"(?i)bridging", "bridging"),
    (r"(?i)visitor", "other_temp"),
    (r"(?i)australian\s*citizen|aust.*resident", "returning_au"),
    (r"(?i)temporary", "other_temp"),
    (r"(?i)permanent", "permanent"),
    (r"(?i)other", "other"),
]
VISA_GROUP_TOTAL, VISA_GROUP_NOT_TOTAL = r"(?i)total", r"(?i)Postgraduate Research"
#: Titles of data sets.
DATASET_RULES = [
    (r"(?i)^student", "student"),
    (r"(?i)^visitor", "visitor"),
    (r"(?i)working\s*holiday", "working_holiday"),
    (r"(?i)temporary graduate", "other_temp"),
    (r"(?i)temporary work \(skilled\)", "skilled"),
    (r"(?i)temporary\s*resident.*skilled|^skilled", "skilled"),
    (r"(?i)^family|partner", "family"),
    (r"(?i)bridging", "bridging"),
    (r"(?i)^permanent", "permanent"),
]
DIRECTION_RULES = [(r"(?i)arrival", "arrival"), (r"(?i)departure", "departure")]


def by_rules(label, rules: list[tuple[str, str]]) -> Column:
    """The category of the first rule that matches; null if none does, or the label is null."""
    label = label if isinstance(label, Column) else F.col(label)
    out = None
    for pattern, value in rules:
        out = F.when(label.rlike(pattern), value) if out is None else out.when(label.rlike(pattern), value)
    return F.when(label.isNotNull(), out)


def visa_group(label) -> Column:
    label = F.trim(label if isinstance(label, Column) else F.col(label))
    total = label.rlike(VISA_GROUP_TOTAL) & ~label.rlike(VISA_GROUP_NOT_TOTAL)
    return F.when(~total, by_rules(label, VISA_GROUP_RULES))


def subclass(label) -> Column:
    return by_rules(label, SUBCLASS_RULES)


def dataset(title) -> Column:
    return by_rules(title, DATASET_RULES)


def direction(label) -> Column:
    return by_rules(label, DIRECTION_RULES)


def regime_by_breaks(period, breaks: list[str]) -> Column:
    """R2 before the first break, R3 from it to the second, and so on; `all` without breaks."""
    period = period if isinstance(period, Column) else F.col(period)
    out = F.lit("R2" if breaks else "all")
    for k, b in enumerate(sorted(breaks)):
        out = F.when(period >= F.lit(b).cast("date"), f"R{k + 3}").otherwise(out)
    return out


def regime_by_ranges(period, ranges: list[tuple[str, str, str]]) -> Column:
    """The name of the first range (name, first day, last day) that holds the period."""
    period = period if isinstance(period, Column) else F.col(period)
    out = None
    for name, a, b in ranges:
        hit = period.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
