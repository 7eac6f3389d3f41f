"""Specifications from listing titles and tags, as a map Column; the longest phrase of a vocabulary wins.

Phrases are looked for in a normalised text between two spaces, worked out once for each row (``_once``): a Column that is named
again is evaluated again, and conditions and lambdas are out of reach of Spark's elimination of common expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of each field and what they mean.
LAYOUTS = {"full size": "full", "fullsize": "full", "100": "full", "1800": "1800", "96": "1800", "tkl": "tkl", "tenkeyless": "tkl", "80": "tkl", "87": "tkl", "75": "75", "65": "65", "60": "60", "40": "40", "alice": "alice", "split": "split"}
SWITCHES = {"silent linear": "silent-linear", "silent tactile": "silent-tactile", "linear": "linear", "tactile": "tactile", "clicky": "clicky", "magnetic": "magnetic", "hall effect": "magnetic", "he": "magnetic", "tmr": "magnetic", "topre": "topre", "optical": "optical"}
CASES = {"aluminum": "aluminum", "aluminium": "aluminum", "all metal": "aluminum", "polycarbonate": "polycarbonate", "wood": "wood", "plastic": "plastic"}
MOUNTS = {"gasket": "gasket", "tray mount": "tray", "top mount": "top", "plate mount": "plate"}


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _between_spaces(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def phrase_value(text: Column, vocabulary: dict[str, str]) -> Column:
    """The meaning of the longest phrase that stands in normalised ``text`` between spaces; null if none does."""
    ranked = sorted(vocabulary.items(), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(text.contains(f" {k} "), F.lit(v)) for k, v in ranked))


def _any(text: Column, *phrases: str) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(f" {p} ")
    return found


def keyboard_spec(text: Column) -> Column:
    """Fields of a keyboard from its normalised title and tags, as text values; absent fields are absent."""
    return _once(_between_spaces(text), _keyboard_fields)


def _keyboard_fields(text: Column) -> Column:
    radio, tooth, wired = _any(text, "2 4ghz", "2 4 ghz", "24ghz"), _any(text, "bluetooth"), _any(text, "wired")
    link = (
        F.when(_any(text, "tri mode", "trimode", "3 mode") | (tooth & radio & wired), "tri-mode")
        .when(radio, "2.4ghz")
        .when(tooth, "bluetooth")
        .when(wired & ~_any(text, "wireless"), "wired")
    )
    # a fixed value: how listings state the number of keys
    keys = F.regexp_extract(text, r"\b(\d{2,3})\s*(?:key|keys|key layout)\b", 1)
    fields = {
        "layout_size": phrase_value(text, LAYOUTS),
        "switch_type": phrase_value(text, SWITCHES),
        "case_material": phrase_value(text, CASES),
        "mount_type": phrase_value(text, MOUNTS),
        "hot_swap": F.when(_any(text, "hotswap", "hot swap", "hot swappable"), "true"),
        "connectivity": link,
        "keycap_material": F.when(_any(text, "pbt"), "pbt").when(_any(text, "abs"), "abs"),
        "key_count": F.when(keys != "", keys),
    }
    return _present(fields)


def _present(fields: dict[str, Column]) -> Column:
    whole = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


#: Phrases of a monitor's fields and what they mean; of phrases of one length the first that stands counts.
PANELS = {"qd oled": "qd-oled", "qdoled": "qd-oled", "oled": "oled", "mini led": "mini-led", "miniled": "mini-led", "ips black": "ips", "nano ips": "ips", "fast ips": "ips", "fast va": "va", "ips": "ips", "va": "va", "tn": "tn"}
HDR = {"displayhdr 1000": "hdr1000", "displayhdr 600": "hdr600", "displayhdr 400": "hdr400", "true black 500": "true-black-500", "true black 400": "true-black-400", "hdr1400": "hdr1400", "hdr 1400": "hdr1400", "hdr1000": "hdr1000", "hdr 1000": "hdr1000", "hdr600": "hdr600", "hdr 600": "hdr600", "hdr500": "hdr500", "hdr 500": "hdr500", "hdr400": "hdr400", "hdr 400": "hdr400", "hdr10": "hdr10", "hdr 10": "hdr10"}
ASPECTS = {"16 10": "16:10", "32 9": "32:9", "21 9": "21:9", "16 9": "16:9"}
WIDE = ("ultrawide", "ultra wide")
RESOLUTIONS = {
    "dual-4k": ("dual uhd", "dual 4k", "duhd", "7680 x 2160", "7680x2160"),
    "dual-1440p": ("dual qhd", "dqhd", "dual 1440p", "5120 x 1440", "5120x1440", "dual wqhd", "dual quad hd"),
    "ultrawide-5k2k": ("5k2k", "5120 x 2160", "5120x2160", "wuhd"),
    "6k": ("6k",),
    "5k": ("5k", "5120 x 2880", "5120x2880"),
    "ultrawide-1440p": ("3440 x 1440", "3440x1440", "uwqhd", "uw qhd", "ultra wqhd", "ultrawide qhd", "ultrawide quad hd", "ultrawide wqhd", "ultra wide qhd", "uw5k"),
    "ultrawide-1080p": ("2560 x 1080", "2560x1080", "uwfhd", "uw fhd", "ultrawide fhd", "ultrawide full hd", "ultra wide fhd"),
    "4k": ("4k", "uhd", "2160p", "3840 x 2160", "3840x2160", "ultra hd"),
    "1440p": ("qhd", "1440p", "2560 x 1440", "2560x1440", "2k", "quad hd"),
    "1080p": ("fhd", "1080p", "full hd", "1920 x 1080", "1920x1080"),
}
#: How titles and tags state a size, a refresh rate and a curvature.
SIZE_IN_TITLE = r"(?<![\d.])(\d{2}(?:\.\d)?)\s*(?:[\"\u2033\u201d]|-?\s?[Ii]nch(?:es)?\b|-?\s?[Ii]n\b)"
SIZE_TAG = r"^(?:screen size:? )?(\d{2}(?:\.\d)?)(?: ?(?:inch|in))?$"
RATE_IN_TITLE, RATE_TAG, RADIUS = r"(?<![\d.])(\d{2,3}) ?hz\b", r"^(?:refresh rate )?(\d{2,3}) ?hz(?: refresh(?: rate)?)?$", r"\b\d{3,4}r\b"


def resolution(text: Column) -> Column:
    """The native resolution that a normalised text between spaces names. Names of double and wide panels come before those of their halves."""
    named = {k: _any(text, *v) for k, v in RESOLUTIONS.items()}
    wide = _any(text, *WIDE, "21 9", "uwqhd", "uw qhd")
    quad, full = named["1440p"], named["1080p"]
    return (
        F.when(named["dual-4k"], "dual-4k")
        .when(named["dual-1440p"], "dual-1440p")
        .when(named["ultrawide-5k2k"], "ultrawide-5k2k")
        .when(named["6k"], "6k")
        .when(named["5k"], F.when(wide, "ultrawide-5k2k").otherwise("5k"))
        .when(named["ultrawide-1440p"], "ultrawide-1440p")
        .when(named["ultrawide-1080p"], "ultrawide-1080p")
        .when(wide & (quad | _any(text, "wqhd")) & ~full, "ultrawide-1440p")
        .when(wide & full & ~quad, "ultrawide-1080p")
        .when(named["4k"], "4k")
        .when(quad, "1440p")
        .when(full, "1080p")
    )


def _between(value: Column, low: float, high: float) -> Column:
    return _once(value, lambda x: F.when(x.between(low, high), x))


def monitor_spec(title: Column, tags: Column, normal) -> Column:
    """Fields of a monitor from its title and tags (an array), as text values; absent fields are absent.

    ``normal`` makes the normal form of a text column. Sizes are read from the title as it stands, where the inch sign is left.
    """
    given = F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))

    def normalised(raw: Column) -> Column:
        norms = F.struct(normal(raw["title"]).alias("title"), F.transform(raw["tags"], lambda t: normal(F.coalesce(t, F.lit("")))).alias("tags"))
        return _once(norms, lambda norm: joined(raw, norm))

    def joined(raw: Column, norm: Column) -> Column:
        text = _between_spaces(F.concat_ws(" ", norm["title"], F.array_join(norm["tags"], " ")))
        return _once(text, lambda x: _once(resolution(x), lambda sharp: _monitor_fields(raw, norm, x, sharp)))

    return _once(given, normalised)


def _monitor_fields(raw: Column, norm: Column, text: Column, sharp: Column) -> Column:
    stated = phrase_value(text, ASPECTS)
    shape = F.coalesce(stated, F.when(sharp.startswith("ultrawide-"), "21:9").when(sharp.startswith("dual-"), "32:9").when(_any(text, *WIDE), "21:9"))
    # what did not match is empty, and a cast that fails costs more than all phrases
    number = lambda c, kind: F.transform(c, lambda x: F.nullif(x, F.lit("")).try_cast(kind))
    in_title = F.array_max(number(F.regexp_extract_all(norm["title"], F.lit(RATE_IN_TITLE), 1), "long"))
    in_tags = F.array_max(number(F.transform(norm["tags"], lambda t: F.regexp_extract(t, RATE_TAG, 1)), "long"))
    sizes = F.concat(F.regexp_extract_all(raw["title"], F.lit(SIZE_IN_TITLE), 1), F.transform(raw["tags"], lambda t: F.regexp_extract(F.lower(F.trim(t)), SIZE_TAG, 1)))
    fits = F.filter(number(sizes, "double"), lambda x: x.between(10, 100))
    curve = F.struct((_any(text, "curved") | text.rlike(RADIUS)).alias("bent"), _any(text, "flat").alias("flat"))
    return _present({
        "panel_type": phrase_value(text, PANELS),
        "resolution": sharp,
        "aspect_ratio": shape,
        "refresh_hz": _between(F.coalesce(in_title, in_tags), 30, 1000).cast("string"),
        "size_in": F.get(fits, 0).cast("string"),
        "curved": _once(curve, lambda c: F.when(c["bent"] & ~c["flat"], "true").when(c["flat"] & ~c["bent"], "false")),
        "hdr": phrase_value(text, HDR),
        "usb_c": F.when(_any(text, "usb c", "type c", "thunderbolt"), "true"),
        "speakers": F.when(_any(text, "speaker", "speakers"), "true"),
    })


def spec_of(category: str, title: Column, tags: Column, normal) -> Column:
    """The specification by the category's own extractor; an unknown category is an error."""
    if category == "keyboards":
        return keyboard_spec(F.concat_ws(" ", normal(F.coalesce(title, F.lit(""))), normal(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))))
    if category == "monitors":
        return monitor_spec(title, tags, normal)
    raise KeyError(f"no extractor for {category}")
