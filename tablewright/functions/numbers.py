"""Number scalars, prices, metering and conversions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down, also for negative numbers."""
    return F.floor(a / b)


def floor_mod(a: Column, b: Column) -> Column:
    return F.pmod(a, b)


def tier(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The result of the first step whose lower bound the value reaches; steps fall."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for low, result in steps[1:]:
        out = out.when(value >= low, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def coupon(total: Column, code: Column) -> Column:
    """SAVE10 takes a tenth, SAVE20 a fifth."""
    return total * F.when(code == "SAVE10", 0.9).when(code == "SAVE20", 0.8).otherwise(1.0)


def surcharge_then_discount(price: Column, weekend: Column, student: Column) -> Column:
    """A quarter more on weekends, then 15 % less for students."""
    raised = price * F.when(weekend, 1.25).otherwise(1.0)
    return raised * F.when(student, 0.85).otherwise(1.0)


def packed_price(price: Column, packaging: float = 0.05, fee: float = 1.50) -> Column:
    return price * (1 + packaging) + fee


def checkout(price: Column, promo: Column, bulk: Column, member: Column, tax: float = 0.08) -> Column:
    """Promotion, bulk and member reductions one after another, then tax."""
    for test, share in ((promo, 0.10), (bulk, 0.05), (member, 0.02)):
        price = price * F.when(test, 1 - share).otherwise(1.0)
    return price * (1 + tax)


def gross_pay(hours: Column, rate: Column, manager: Column) -> Column:
    """Hours above 40 count half more; managers get 2000 from a gross of 20000."""
    base = F.least(hours, F.lit(40.0)) * rate + F.greatest(hours - 40, F.lit(0.0)) * rate * 1.5
    return base + F.when(manager & (base >= 20000), 2000.0).otherwise(0.0)


def income_tax(gross: Column) -> Column:
    return gross * tier(gross, [(30000.0, 0.20), (15000.0, 0.10)], 0.0)


def per_person(total: Column, tip: Column, people: Column) -> Column:
    """A bad or non-positive head count is one."""
    heads = F.greatest(F.coalesce(people.try_cast("int"), F.lit(1)), F.lit(1))
    return total * (1 + tip / 100) / heads


def bmi(weight_kg: Column, height_m: Column) -> Column:
    return weight_kg / (height_m * height_m)


def bmi_class(value: Column) -> Column:
    return tier(value, [(30.0, "obese"), (25.0, "overweight"), (18.5, "normal")], "underweight")


#: Activity factors.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725}


def daily_calories(weight: Column, height: Column, age: Column, activity: Column, strict: bool = False) -> Column:
    """10 w + 6.25 h - 5 a by activity; an unknown activity counts as sedentary, or fails if strict."""
    factor = F.coalesce(*(F.when(activity == k, F.lit(v)) for k, v in ACTIVITY.items()))
    other = F.raise_error(F.lit("unknown activity")).cast("double") if strict else F.lit(ACTIVITY["sedentary"])
    return (10 * weight + 6.25 * height - 5 * age) * F.coalesce(factor, other)


#: Conversions by name: functions in a dispatch table.
CONVERT = {
    "c_to_f": lambda x: x * 9 / 5 + 32,
    "f_to_c": lambda x: (x - 32) * 5 / 9,
    "km_to_miles": lambda x: x * 0.621371,
    "kg_to_lb": lambda x: x * 2.20462,
}


def reading_minutes(n_words: Column) -> Column:
    return F.floor(n_words / 200)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def token_cost(tokens: Column, price_per_million: Column | float) -> Column:
    return tokens / 1e6 * price_per_million


def parsed_int(text: Column) -> Column:
    """An integer, or null; signs and blanks around it are allowed."""
    return F.when(text.rlike(r"^[ ]*[+-]?[0-9]+[ ]*\z"), F.btrim(text)).try_cast("bigint")
