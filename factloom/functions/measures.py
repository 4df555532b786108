"""Column functions for units, limits and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor of each SI prefix.
PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9}
#: Units that may carry a prefix.
BASE_UNITS = ("V", "A", "W", "Hz", "F", "H", "s", "Ohm")


def unit_factor(unit: Column) -> Column:
    """Factor to the SI unit of a printed unit; null if it is not known."""
    known = F.create_map(*[F.lit(x) for p, f in PREFIXES.items() for u in BASE_UNITS for x in (p + u, f)])
    return F.try_element_at(known, unit)


def verdict(value: Column, low: Column, typical: Column, high: Column, tolerance: float = 0.001) -> Column:
    """below, above or inside the limits, each widened by the tolerance; with none, how the value stands to the typical one."""
    return (
        F.when(value.isNull(), "not measured")
        .when(low.isNotNull() & (value < low - F.abs(low) * tolerance), "below")
        .when(high.isNotNull() & (value > high + F.abs(high) * tolerance), "above")
        .when(low.isNotNull() | high.isNotNull(), "inside")
        .when(typical.isNotNull() & (typical != 0), "typical")
        .otherwise("no limit")
    )


def significant(value: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


#: Marks that a data sheet prints in several ways, and what they are read as.
MARKS = (("−", "-"), ("–", "-"), ("—", "-"), ("µ", "u"), ("μ", "u"), ("Ω", "ohm"), ("√ Hz", "rtHz"), ("√Hz", "rtHz"), ("Hz1/2", "rtHz"), ("°", ""), (" ", " "))
#: Units that may carry a prefix, the longer ones first where one ends in another; K is kilo as well.
PRINTED_UNITS = ("V/rtHz", "ohm", "mhos", "Hz", "A", "V", "F", "S", "s", "C", "W")
PRINTED_PREFIXES = PREFIXES | {"K": 1e3}
#: Symbols that name one quantity.
SYMBOLS = {"vceosus": "vbrceo", "vbeon": "vbe", "cobo": "cob", "cc": "cob", "cibo": "cib", "ce": "cib", "f": "nf", "bvgss": "vbrgss", "yfs": "gfs", "yos": "gos", "ct": "cd", "ctot": "cd", "bvdss": "vbrdss"}
#: Names of conditions that are written otherwise; temperatures, which keep their sign.
CONDITIONS, TEMPERATURES = {"RS": "RG", "IGS": "IG"}, ("TA", "TJ", "TC", "TAMB")
#: A condition as it is printed: name, sign, number, unit.
CONDITION = r"([A-Za-z][A-Za-z0-9_()\[\]/]*)\s*[=≥≤<>]\s*([-+]?\d+(?:\.\d+)?)\s*([a-zA-Z/%]*)"


def cleaned(text: Column) -> Column:
    """Marks in their plain spelling."""
    for a, b in MARKS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def printed_factor(unit: Column) -> Column:
    """Factor to the SI unit of a unit as a sheet prints it ('mAdc', 'kohm', 'umhos'); 1 for none; null if it is not known."""
    known = {p + u: f for u in PRINTED_UNITS for p, f in PRINTED_PREFIXES.items()} | {u: f for u, f in PRINTED_PREFIXES.items() if u} | {"": 1.0, "-": 1.0, "dB": 1.0, "%": 1.0, "X10-4": 1e-4, "x10-4": 1e-4}
    # "m" and the like alone are prefixes; "mhos" is a unit of its own, not milli-hos.
    known |= {p + "mhos": f for p, f in PRINTED_PREFIXES.items()}
    bare = F.regexp_replace(F.replace(F.trim(cleaned(F.coalesce(unit, F.lit("")))), F.lit(" "), F.lit("")), "dc$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), bare)


def quantity(symbol: Column, parameter: Column) -> Column:
    """The quantity that a row measures: its symbol without marks and brackets, one name for each, helped by the parameter's words."""
    bare = F.regexp_replace(F.regexp_replace(cleaned(F.coalesce(symbol, F.lit(""))), r"(?i)[*†]|\(note\)|\([0-9]\)|note *[0-9]", ""), r"[\s|()\[\]_]", "")
    key, words = F.regexp_replace(F.lower(bare), "^(nf|hfe)[0-9]+$", "$1"), F.lower(F.coalesce(parameter, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    broken = words.contains("breakdown") | words.contains("sustaining")
    return (
        F.when(bare.rlike("^h[FfEe]{2}[0-9]*$"), F.when(F.substring(bare, 2, 1) == "F", "hFE").otherwise("hfe"))
        .when(words.contains("noise figure"), "nf")
        .when(broken & key.isin("vds", "vbrdss", "bvdss"), "vbrdss")
        .when(broken & key.isin("vr", "vbr", "vbrr"), "vbr")
        .otherwise(F.coalesce(F.try_element_at(known, key), key))
    )


def conditions(text: Column) -> Column:
    """Map of name to SI value of a row's test conditions: magnitudes, but temperatures keep their sign; the first of a name
    counts; zeros, 25 degrees and a frequency that is a band are left out."""

    def read(clean: Column) -> Column:
        part = lambda k: F.regexp_extract_all(clean, F.lit(CONDITION), k)
        band = clean.rlike(r"(?i)f\s*=\s*[\d.]+\s*\w*\s*(to|~|-)\s*[\d.]+")
        entries = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))

        def one(x: Column) -> Column:
            name = F.upper(F.regexp_replace(x["a"], r"[()\[\]\s_]", ""))
            name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in CONDITIONS.items() for y in pair]), name), name)
            number = x["b"].cast("double")
            value = number * F.coalesce(printed_factor(x["c"]), F.lit(1.0))
            hot = name.isin(*TEMPERATURES)
            drop = (band & (F.lower(x["a"]) == "f")) | (value == 0) | (hot & (number == 25))
            return F.when(~drop, F.struct(name.alias("name"), F.when(hot, value).otherwise(F.abs(value)).alias("value")))

        kept = F.array_compact(F.transform(entries, one))
        first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: y["name"]), x["name"]) == i + 1)
        return F.map_from_entries(first)

    return F.transform(F.array(cleaned(F.coalesce(text, F.lit("")))), read)[0]


def shown(value: Column, factor: Column, negative: Column) -> Column:
    """A measured value as its sheet would print it: in the row's unit, negative if the limits are, four digits."""
    return significant(F.abs(value) / factor * F.when(negative, -1.0).otherwise(1.0))


def cell(absent: Column, value: Column, error: Column, declared: Column) -> Column:
    """What a page shows for a row: the card lacks what it takes, else measured, else an error, else declared not to be, else none."""
    return F.when(absent, "card").when(value.isNotNull(), "measured").when(error.isNotNull(), "error").when(declared, "declared not").otherwise("none")


def thousandths(x: Column, width: Column) -> Column:
    """A place as thousandths of the page, cut off."""
    return (x * 1000 / width).cast("int")


#: What a number in a netlist may end in.
SCALES = (("meg", 1e6), ("mil", 25.4e-6), ("t", 1e12), ("g", 1e9), ("k", 1e3), ("m", 1e-3), ("u", 1e-6), ("n", 1e-9), ("p", 1e-12), ("f", 1e-15))


def netlist_number(text: Column) -> Column:
    """A number as netlists write it, with its scale; letters after that are a unit and say nothing. Null if it is none."""
    form = r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)([a-z]*)$"
    low = F.lower(F.trim(text))
    number, ending = F.regexp_extract(low, form, 1).try_cast("double"), F.regexp_extract(low, form, 2)
    scale = F
    for word, factor in SCALES:
        scale = scale.when(ending.startswith(word), F.lit(factor))
    return number * scale.otherwise(F.lit(1.0))


def card_parameters(card: Column) -> Column:
    """Map of lower-case name to text of the parameters in a model's card; the last of a name counts."""
    pairs = F.regexp_extract_all(F.lower(card), F.lit(r"([a-z][a-z0-9_]*)\s*=\s*([^\s()=]+)"), 0)
    split = F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.trim(F.split_part(x, F.lit("="), F.lit(2))).alias("v")))
    names = lambda a: F.transform(a, lambda y: y["k"])
    last = F.filter(split, lambda x, i: ~F.array_contains(names(F.slice(split, i + 2, F.size(split))), x["k"]))
    return F.map_from_entries(last)


def digest(*values: Column) -> Column:
    """Sixteen characters that tell records with equal values."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *values), 256), 1, 16)
