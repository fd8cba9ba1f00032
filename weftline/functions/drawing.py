"""Column functions of the schedule chart and the tree of symbols: colours, places, labels, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hue of the largest slack, the tick steps of the time axis in milliseconds, and the least space between ticks in pixels.
MAX_HUE = 220
STEPS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 15000, 30000, 60000, 120000, 300000, 600000)
SPACING = 100


def half_up(x: Column) -> Column:
    """To the nearest integer, halves up."""
    return F.floor(x + 0.5).cast("long")


def slack_color(slack: Column, most: Column) -> Column:
    """From red without slack to blue for the most there is."""
    hue = F.when(most > 0, half_up(slack / most * MAX_HUE)).otherwise(0)
    return F.concat(F.lit("hsl("), hue.cast("string"), F.lit(", 80%, 50%)"))


def packed_rgb(hsl: Column) -> Column:
    """0xRRGGBB of `hsl(h, s%, l%)`; white for other text."""
    part = lambda i: F.try_element_at(F.transform(F.regexp_extract_all(hsl, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double")), F.lit(i))
    s, l = part(2) / 100, part(3) / 100
    # a channel by its distance on the circle of hues, in twelfths
    reach = s * F.least(l, 1 - l)

    def channel(n):
        k = F.pmod(part(1) / 30 + n, F.lit(12.0))
        return half_up(255 * (l - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

    rgb = channel(0) * 65536 + channel(8) * 256 + channel(4)
    return F.when(hsl.rlike(r"hsl\(\d+,\s*\d+%,\s*\d+%\)"), rgb).otherwise(F.lit(0xFFFFFF))


def short_duration(ms: Column) -> Column:
    """500ms, 12.3s, 1m 10s or 2m."""
    s, text = ms / 1000, lambda c: c.cast("string")
    minutes, rest = F.floor(s / 60), half_up(s % 60)
    return F.when(ms < 1000, F.concat(text(half_up(ms)), F.lit("ms"))).when(s < 60, F.concat(F.format_string("%.1f", F.floor(s * 10 + 0.5) / 10), F.lit("s"))).when(rest == 0, F.concat(text(minutes), F.lit("m"))).otherwise(F.concat(text(minutes), F.lit("m "), text(rest), F.lit("s")))


def long_duration(ms: Column) -> Column:
    """1h 2m 3s, -4s or 7ms: whole milliseconds below a second, whole seconds from there on."""
    whole = F.signum(ms) * F.floor(F.abs(ms) + 0.5)
    size = F.abs(whole).cast("long")
    s = F.floor((size + 500) / 1000).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s / 60) % 60, "m"), part(s % 60, "s"))
    return F.when(size == 0, F.lit("0s")).otherwise(F.concat(F.when(whole < 0, F.lit("-")).otherwise(""), F.when(size < 1000, F.concat(size.cast("string"), F.lit("ms"))).otherwise(text)))


def shortened(name: Column, most: int) -> Column:
    """The name, or so many characters of it with ... at the end."""
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 3), F.lit("...")))


def time_step(pixels_per_ms: Column, spacing: int = SPACING) -> Column:
    """The smallest step whose ticks are at least so many pixels apart; the largest if none is."""
    fit = F.filter(F.array(*[F.lit(x) for x in STEPS]), lambda x: x >= F.lit(spacing) / pixels_per_ms)
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(STEPS[-1]))


def time_to_x(ms: Column, scale: Column) -> Column:
    return ms * scale


def lane_to_y(lane: Column, height: Column) -> Column:
    return lane * height


def matches(name: Column, search: str) -> Column:
    """Whether the name holds the text, whatever the case."""
    return F.contains(F.lower(name), F.lit(search.lower()))


def inside(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Whether a point lies in a rectangle, its edges included."""
    return x.between(left, right) & y.between(top, bottom)


def kind_label(symbol_type: Column, kind: Column) -> Column:
    return F.when(symbol_type == "module_def", F.lower(kind)).when(symbol_type == "impl", F.lit("impl")).otherwise("?")


def display_name(symbol_type: Column, name: Column, impl_name: Column) -> Column:
    return F.when(symbol_type == "impl", impl_name).otherwise(name)


def badge(visibility: Column) -> Column:
    return F.when(visibility == "public", F.lit('<span class="tree-vis">pub</span>')).otherwise("")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text
