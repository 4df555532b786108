"""Column functions for names, identifiers, links and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(name: Column) -> Column:
    """Upper case, letters and digits alone: the key under which names are looked up."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def base36(number: Column) -> Column:
    """A number from 0 in the digits 0-9a-z."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def from_base36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("bigint")


def canonical(name: Column) -> Column:
    """A printed name without plural s, leading hyphens and distributor suffix; null if nothing stands."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "^-+", ""), "(-[A-Z]{2,3}|S)$", "")
    return F.when(bare != "", bare)


def base_part(name: Column) -> Column:
    """The name without one to three trailing letters after its last digit."""
    return F.regexp_replace(name, "([0-9])[A-Z]{1,3}$", "$1")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)


def page_link(template: Column, url: Column, page: Column, offset: Column) -> Column:
    """Template with {url}, {n} and {leaf} filled; the plain url without one."""
    filled = F.replace(F.replace(F.replace(template, F.lit("{url}"), url), F.lit("{n}"), page.cast("string")), F.lit("{leaf}"), (page - 1 + offset).cast("string"))
    return F.coalesce(filled, url)


#: The zoom of a link to a place, and how far in from the left and the top it begins (of the page's size).
ZOOM, INSET = 200, 0.06


def zoomed(link: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """A page link with the place of a box (thousandths of the page) some way in from the left and the top; ties to even."""
    at = lambda v, side: F.bround(F.greatest(F.lit(0.0), v / 1000 - INSET) * side).cast("bigint").cast("string")
    with_place = F.concat(link, F.lit(f"&zoom={ZOOM},"), at(x0, width), F.lit(","), at(y0, height), F.lit("&h="), F.bround(height).cast("bigint").cast("string"))
    ready = link.contains("#page=") & x0.isNotNull() & y0.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(ready, with_place).otherwise(link)


def short_link(link: Column, base: Column) -> Column:
    """What of a link stands after the document's own address; the whole link where it does not begin with it."""
    return F.when(F.startswith(link, base), F.substring(link, F.length(base) + 1, F.length(link))).otherwise(link)


def clean_title(title: Column) -> Column:
    """A title without entities and doubled spaces, nor dashes, bars and spaces at its ends."""
    plain = F.regexp_replace(F.regexp_replace(title, "&[a-z]+;", " "), "[ \\t\\n]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, "^[ |-]+", ""), "[ |-]+$", "")


#: What a name may end in and what it is without that: (why, pattern; the first group is the name left).
KIN_STEPS = (
    ("grade", "^(2S[ABCDJK][0-9]{2,4})-?(GR|BL|Y|O|R|P|E|F|K|V|G)$"),
    ("grade", "^((BC|BCY|BF|MPS|MPSA|PN)[0-9]{2,4})[ABC]$"),
    ("packing", "^(.*[0-9][A-Z]{0,2})(TR|TA|TB|TAP|RL|RLG|ZL|ZLG|BU|BK|CT)$"),
    ("brand", "^([0-9]{1,2}[A-Z]{1,2}[0-9]{1,2})(EH|LPS|WA|WB|WC|WXT)$"),
)
#: Endings of a valve's bulb.
ENVELOPES = ("GT", "G", "GTA", "GTB", "GA", "GB", "A")
#: makers' letters before a bare number of a regulator and of a logic family.
MAKERS = (("^7[89]M?[0-9]{2}[A-Z]{0,2}$", ("L", "MC", "UA", "LM", "KA", "KIA", "NJM")), ("^4[0-9]{3}[A-Z]{0,3}$", ("CD", "HEF", "MC1", "TC", "NJU")))


def peeled(name: Column) -> Column:
    """(why, name) one step up from a name: the first ending that it has, taken off; null if it has none."""

    def step(x: Column) -> Column:
        out = F
        for why, pattern in KIN_STEPS:
            out = out.when(x.rlike(pattern), F.struct(F.lit(why).alias("why"), F.regexp_extract(x, pattern, 1).alias("name")))
        return out.otherwise(F.lit(None))

    return F.transform(F.array(name), step)[0]  # the name is worked out once, however often step speaks of it


def kin_names(name: Column, steps: int = 3) -> Column:
    """Array of (why, name): up to three steps up, a valve's other envelopes, makers' names for a bare number; in that order."""
    found, at = [], name
    for _ in range(steps):
        step = peeled(at)
        found.append(step)
        at = step["name"]
    named = lambda why, parts: F.array(*[F.struct(F.lit(why).alias("why"), p.alias("name")) for p in parts])
    none = F.array().cast("array<struct<why:string,name:string>>")
    groups = [F.array_compact(F.array(*found)), F.when(name.rlike("^[0-9]{1,2}[A-Z]{1,3}[0-9]{1,2}$"), named("envelope", [F.concat(name, F.lit(e)) for e in ENVELOPES])).otherwise(none)]
    groups += [F.when(name.rlike(p), named("maker's name", [F.concat(F.lit(m), name) for m in makers])).otherwise(none) for p, makers in MAKERS]
    return F.concat(*groups)


#: Numbering schemes (JIS C 7012, JEDEC, Pro Electron): form with its pieces, and what the letter piece says.
SCHEMES = (
    ("jis", "^2S([A-DJK])([0-9]{2,4})([A-Z]{0,2})$", {"A": "pnp", "B": "pnp", "C": "npn", "D": "npn", "J": "p-channel", "K": "n-channel"}),
    ("pro electron", "^B([CDFSU])([0-9]{2,3})([A-Z]?)$", {"C": "small signal", "D": "power", "F": "high frequency", "S": "switch", "U": "power switch"}),
    ("jedec", "^([1-3])N([0-9]{2,4})([A-Z]{0,2})$", {"1": "one junction", "2": "two junctions", "3": "three junctions"}),
)


def scheme_decoded(name: Column) -> Column:
    """(scheme, letter, meaning, serial, suffix) by the first scheme whose form the whole name has and whose letter has a meaning."""

    def read(x: Column) -> Column:
        out = F
        for scheme, form, meaning in SCHEMES:
            letter = F.regexp_extract(x, form, 1)
            said = F.try_element_at(F.create_map(*[F.lit(y) for pair in meaning.items() for y in pair]), letter)
            piece = F.struct(F.lit(scheme).alias("scheme"), letter.alias("letter"), said.alias("meaning"), F.regexp_extract(x, form, 2).cast("int").alias("serial"), F.regexp_extract(x, form, 3).alias("suffix"))
            out = out.when(x.rlike(form) & said.isNotNull(), piece)
        return out.otherwise(F.lit(None))

    return F.transform(F.array(name), read)[0]


def shorter_names(name: Column, letters: int = 3) -> Column:
    """The name and what is left when one letter after the other goes from its end, as far as there are letters."""
    whole = [F.when(F.right(name, F.lit(k)).rlike(f"^[A-Z]{{{k}}}$") if k else F.lit(True), F.substring(name, F.lit(1), F.length(name) - k)) for k in range(letters + 1)]
    return F.array_compact(F.array(*whole))


def url_name(url: Column) -> Column:
    """The last segment of a URL's path that says something, without its ending."""
    segments = F.filter(F.split(url_path(url), "/"), lambda x: F.length(x) > 0)
    return F.regexp_replace(F.try_element_at(segments, F.lit(-1)), "[.][a-z0-9]{1,5}$", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def excerpt_key(*parts: Column) -> Column:
    """Parts joined by bars and a short digest of them, for caches."""
    joined = F.concat_ws("|", *parts)
    return F.concat_ws("|", joined, F.substring(F.sha2(joined, 256), 1, 8))
