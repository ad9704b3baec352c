"""CSS colours: parsing to ``#rrggbb`` + alpha, OKLCH chroma and CIEDE2000.

The formulas are long, so they are written as Spark SQL text: one parsed expression instead of
hundreds of Column calls. Arguments are SQL expressions, usually a column name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import BLANKS_SQL, sql_let

NEAR_MISS = 6.0
NEUTRAL_CHROMA = 0.025

# The CSS named colours.
NAMED_COLORS = {
    "aliceblue": "f0f8ff", "antiquewhite": "faebd7", "aqua": "00ffff", "aquamarine": "7fffd4",
    "azure": "f0ffff", "beige": "f5f5dc", "bisque": "ffe4c4", "black": "000000",
    "blanchedalmond": "ffebcd", "blue": "0000ff", "blueviolet": "8a2be2", "brown": "a52a2a",
    "burlywood": "deb887", "cadetblue": "5f9ea0", "chartreuse": "7fff00", "chocolate": "d2691e",
    "coral": "ff7f50", "cornflowerblue": "6495ed", "cornsilk": "fff8dc", "crimson": "dc143c",
    "cyan": "00ffff", "darkblue": "00008b", "darkcyan": "008b8b", "darkgoldenrod": "b8860b",
    "darkgray": "a9a9a9", "darkgreen": "006400", "darkgrey": "a9a9a9", "darkkhaki": "bdb76b",
    "darkmagenta": "8b008b", "darkolivegreen": "556b2f", "darkorange": "ff8c00", "darkorchid": "9932cc",
    "darkred": "8b0000", "darksalmon": "e9967a", "darkseagreen": "8fbc8f", "darkslateblue": "483d8b",
    "darkslategray": "2f4f4f", "darkslategrey": "2f4f4f", "darkturquoise": "00ced1",
    "darkviolet": "9400d3", "deeppink": "ff1493", "deepskyblue": "00bfff", "dimgray": "696969",
    "dimgrey": "696969", "dodgerblue": "1e90ff", "firebrick": "b22222", "floralwhite": "fffaf0",
    "forestgreen": "228b22", "fuchsia": "ff00ff", "gainsboro": "dcdcdc", "ghostwhite": "f8f8ff",
    "gold": "ffd700", "goldenrod": "daa520", "gray": "808080", "green": "008000", "greenyellow": "adff2f",
    "grey": "808080", "honeydew": "f0fff0", "hotpink": "ff69b4", "indianred": "cd5c5c",
    "indigo": "4b0082", "ivory": "fffff0", "khaki": "f0e68c", "lavender": "e6e6fa",
    "lavenderblush": "fff0f5", "lawngreen": "7cfc00", "lemonchiffon": "fffacd", "lightblue": "add8e6",
    "lightcoral": "f08080", "lightcyan": "e0ffff", "lightgoldenrodyellow": "fafad2",
    "lightgray": "d3d3d3", "lightgreen": "90ee90", "lightgrey": "d3d3d3", "lightpink": "ffb6c1",
    "lightsalmon": "ffa07a", "lightseagreen": "20b2aa", "lightskyblue": "87cefa",
    "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "b0c4de",
    "lightyellow": "ffffe0", "lime": "00ff00", "limegreen": "32cd32", "linen": "faf0e6",
    "magenta": "ff00ff", "maroon": "800000", "mediumaquamarine": "66cdaa", "mediumblue": "0000cd",
    "mediumorchid": "ba55d3", "mediumpurple": "9370db", "mediumseagreen": "3cb371",
    "mediumslateblue": "7b68ee", "mediumspringgreen": "00fa9a", "mediumturquoise": "48d1cc",
    "mediumvioletred": "c71585", "midnightblue": "191970", "mintcream": "f5fffa", "mistyrose": "ffe4e1",
    "moccasin": "ffe4b5", "navajowhite": "ffdead", "navy": "000080", "oldlace": "fdf5e6",
    "olive": "808000", "olivedrab": "6b8e23", "orange": "ffa500", "orangered": "ff4500",
    "orchid": "da70d6", "palegoldenrod": "eee8aa", "palegreen": "98fb98", "paleturquoise": "afeeee",
    "palevioletred": "db7093", "papayawhip": "ffefd5", "peachpuff": "ffdab9", "peru": "cd853f",
    "pink": "ffc0cb", "plum": "dda0dd", "powderblue": "b0e0e6", "purple": "800080",
    "rebeccapurple": "663399", "red": "ff0000", "rosybrown": "bc8f8f", "royalblue": "4169e1",
    "saddlebrown": "8b4513", "salmon": "fa8072", "sandybrown": "f4a460", "seagreen": "2e8b57",
    "seashell": "fff5ee", "sienna": "a0522d", "silver": "c0c0c0", "skyblue": "87ceeb",
    "slateblue": "6a5acd", "slategray": "708090", "slategrey": "708090", "snow": "fffafa",
    "springgreen": "00ff7f", "steelblue": "4682b4", "tan": "d2b48c", "teal": "008080",
    "thistle": "d8bfd8", "tomato": "ff6347", "turquoise": "40e0d0", "violet": "ee82ee", "wheat": "f5deb3",
    "white": "ffffff", "whitesmoke": "f5f5f5", "yellow": "ffff00", "yellowgreen": "9acd32",
}

# Published colour-space constants.
D65 = (0.3127 / 0.3290, 1.0, (1 - 0.3127 - 0.3290) / 0.3290)
D50 = (0.3457 / 0.3585, 1.0, (1 - 0.3457 - 0.3585) / 0.3585)
RGB_TO_XYZ65 = (
    (0.4123907992659593, 0.357584339383878, 0.1804807884018343),
    (0.2126390058715102, 0.715168678767756, 0.0721923153607337),
    (0.0193308187155918, 0.119194779794626, 0.9505321522496607),
)
XYZ50_TO_RGB = (
    (3.1341359569958707, -1.6173863321612538, -0.4906619460083532),
    (-0.978795502912089, 1.916254567259524, 0.03344273116131949),
    (0.07195537988411677, -0.2289768264158322, 1.405386058324125),
)
RGB_TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LMS_TO_OKLAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
OKLAB_TO_LMS = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.2914855480),
)
LMS_TO_RGB = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)
LAB_K = 24389 / 27
LAB_E = 216 / 24389

NUM = r"(?:[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?)"
ARG = rf"({NUM}(?:%|deg|grad|rad|turn)?|none)"
FUNC = r"(rgba?|hsla?|hwb|lab|lch|oklab|oklch)"
LEGACY = rf"(?i)^(rgba?|hsla?)\(\s*{ARG}\s*,\s*{ARG}\s*,\s*{ARG}\s*(?:,\s*{ARG}\s*)?\)$"
MODERN = rf"(?i)^{FUNC}\(\s*{ARG}\s+{ARG}\s+{ARG}\s*(?:/\s*{ARG}\s*)?\)$"


def _dot(row: tuple, v: tuple) -> str:
    return "(" + " + ".join(f"{k}D * {x}" for k, x in zip(row, v, strict=True)) + ")"


def _matrix(rows: tuple, v: tuple, names: str) -> str:
    cells = (f"{_dot(row, v)} as {n}" for row, n in zip(rows, names, strict=True))
    return f"struct({', '.join(cells)})"


def _byte(channel: str) -> str:
    return f"cast(floor(least(greatest({channel}, 0D), 1D) * 255 + 0.5D) as int)"


def _hex(r: str, g: str, b: str) -> str:
    number = f"{_byte(r)} * 65536 + {_byte(g)} * 256 + {_byte(b)}"
    return f"concat('#', lower(lpad(hex({number}), 6, '0')))"


def _encode(x: str) -> str:
    """Linear light to sRGB."""
    return (
        f"if(abs({x}) > 0.0031308D, "
        f"signum({x}) * (1.055D * pow(abs({x}), {1 / 2.4}D) - 0.055D), {x} * 12.92D)"
    )


def _channels(r: str, g: str, b: str) -> str:
    return f"struct({r} as r, {g} as g, {b} as b)"


def _encoded(rgb: str) -> str:
    return _channels(*[_encode(f"{rgb}.{c}") for c in "rgb"])


def _number(arg: str) -> str:
    digits = f"regexp_replace(lower({arg}), '(?:%|deg|grad|rad|turn)$', '')"
    return f"if(lower({arg}) = 'none', 0D, try_cast({digits} as double))"


def _scaled(arg: str, percent_unit: float, number_unit: float = 1.0) -> str:
    return (
        f"if(endswith({arg}, '%'), {_number(arg)} / 100 * {percent_unit}D, "
        f"{_number(arg)} * {number_unit}D)"
    )


def _degrees(arg: str) -> str:
    unit = (
        f"case when lower({arg}) like '%grad' then 0.9D when lower({arg}) like '%rad' "
        f"then 57.29577951308232D when lower({arg}) like '%turn' then 360D else 1D end"
    )
    return f"({_number(arg)} * {unit})"


def _wheel(h: str, n: int) -> str:
    """Position ``n`` of the HSL hue wheel, in turns of twelve."""
    k = f"pmod({n}D + {h} / 30, 12D)"
    return f"greatest(-1D, least({k} - 3, 9 - {k}, 1D))"


def _hsl(a: str, b: str, c: str) -> str:
    """Strongest, weakest and middle channel, dealt out by the sixth of the hue circle."""
    hsl = f"struct(pmod({_degrees(a)}, 360D) as h, {_number(b)} / 100 as s, {_number(c)} / 100 as l)"
    top = "v.l + v.s * if(v.l < 0.5D, v.l, 1 - v.l)"
    parts = (
        f"struct(cast(floor(v.h / 60) as int) as k, {top} as hi, 2 * v.l - ({top}) as lo, "
        f"({top}) - (({top}) - v.l) * 2 * abs(pmod(v.h / 60, 2D) - 1) as mid)"
    )
    # the strongest, middle and weakest channel by sixth: red, green, blue
    sixths = [
        ["w.hi", "w.mid", "w.lo", "w.lo", "w.mid", "w.hi"],
        ["w.mid", "w.hi", "w.hi", "w.mid", "w.lo", "w.lo"],
        ["w.lo", "w.lo", "w.mid", "w.hi", "w.hi", "w.mid"],
    ]
    channels = [f"element_at(array({', '.join(order)}), w.k + 1)" for order in sixths]
    return sql_let("v", hsl, sql_let("w", parts, _channels(*channels)))


def _hwb(a: str, b: str, c: str) -> str:
    hwb = f"struct({_degrees(a)} as h, {_number(b)} / 100 as w, {_number(c)} / 100 as k)"
    share = "greatest(v.w + v.k, 1D)"
    channels = [
        f"((0.5D - 0.5D * {_wheel('v.h', n)}) * (1 - (v.w + v.k) / {share}) + v.w / {share})"
        for n in (0, 8, 4)
    ]
    return sql_let("v", hwb, _channels(*channels))


def _lab(light: str, a: str, b: str) -> str:
    def inverse(f: str) -> str:
        return f"if(pow({f}, 3D) > {LAB_E}D, pow({f}, 3D), (116 * {f} - 16) / {LAB_K}D)"

    lab = f"struct(({light} + 16) / 116 as fy, {a} as a, {b} as b)"
    xyz = (
        f"struct({inverse('(v.fy + v.a / 500)')} * {D50[0]}D as x, {inverse('v.fy')} as y, "
        f"{inverse('(v.fy - v.b / 200)')} * {D50[2]}D as z)"
    )
    rgb = _matrix(XYZ50_TO_RGB, ("w.x", "w.y", "w.z"), "rgb")
    return sql_let("v", lab, sql_let("w", xyz, sql_let("u", rgb, _encoded("u"))))


def _oklab(light: str, a: str, b: str) -> str:
    lab = f"struct({light} as l, {a} as a, {b} as b)"
    lms = _matrix(OKLAB_TO_LMS, ("v.l", "v.a", "v.b"), "lms")
    rgb = _matrix(LMS_TO_RGB, ("pow(w.l, 3D)", "pow(w.m, 3D)", "pow(w.s, 3D)"), "rgb")
    return sql_let("v", lab, sql_let("w", lms, sql_let("u", rgb, _encoded("u"))))


def _color(color: str, alpha: str) -> str:
    return f"struct({color} as color, cast({alpha} as double) as alpha)"


FULL_HEX = "^#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"


def _named_at(word: str) -> str:
    """Position of a word in the colour table text, 0 when it is not a colour."""
    table = " " + " ".join(f"{k}=#{v}" for k, v in NAMED_COLORS.items())
    return f"if({word} rlike '^[A-Za-z]+$', instr('{table}', concat(' ', lower({word}), '=')), 0)"


def resolvable_sql(raw: str) -> str:
    """Would ``color_sql`` give a colour? Cheap enough to run on every candidate."""
    return (
        f"({raw} rlike '{FULL_HEX}' or {raw} rlike r'{LEGACY}' or {raw} rlike r'{MODERN}' "
        f"or lower({raw}) = 'transparent' or {_named_at(raw)} > 0)"
    )


def hex_sql(raw: str) -> str:
    """``#rgb``, ``#rgba``, ``#rrggbb`` or ``#rrggbbaa`` to (color, alpha)."""
    short = f"regexp_replace(lower(substring({raw}, 2)), '(.)', '$1$1')"
    full = f"if(length({raw}) in (4, 5), {short}, lower(substring({raw}, 2)))"
    alpha = "if(length(d) = 8, cast(conv(substring(d, 7, 2), 16, 10) as int) / 255, null)"
    ok = f"{raw} rlike '{FULL_HEX}'"
    return f"if({ok}, {sql_let('d', full, _color('left(concat(chr(35), d), 7)', alpha))}, null)"


def named_sql(word: str) -> str:
    table = " " + " ".join(f"{k}=#{v}" for k, v in NAMED_COLORS.items())
    found = f"substring('{table}', n + length({word}) + 2, 7)"
    return sql_let("n", _named_at(word), f"if(n = 0, null, {_color(found, 'null')})")


def function_sql(raw: str) -> str:
    """rgb, hsl, hwb, lab, lch, oklab and oklch calls, comma or space separated."""

    def part(i: int) -> str:
        return (
            f"if(s.legacy, regexp_extract(s.t, r'{LEGACY}', {i}), "
            f"regexp_extract(s.t, r'{MODERN}', {i}))"
        )

    parts = (
        f"struct(lower({part(1)}) as fn, {part(2)} as a, {part(3)} as b, {part(4)} as c, "
        f"{part(5)} as alpha)"
    )
    polar = [
        f"{_scaled('p.b', u)} * {t}(radians({_degrees('p.c')}))"
        for u in (150, 0.4)
        for t in ("cos", "sin")
    ]
    channels = f"""case
        when p.fn like 'rgb%' then {_channels(*[_scaled(f"p.{x}", 1.0, 1 / 255) for x in "abc"])}
        when p.fn like 'hsl%' then {_hsl("p.a", "p.b", "p.c")}
        when p.fn = 'hwb' then {_hwb("p.a", "p.b", "p.c")}
        when p.fn = 'lab' then
            {_lab(_scaled("p.a", 100), _scaled("p.b", 125), _scaled("p.c", 125))}
        when p.fn = 'lch' then {_lab(_scaled("p.a", 100), polar[0], polar[1])}
        when p.fn = 'oklab' then
            {_oklab(_scaled("p.a", 1), _scaled("p.b", 0.4), _scaled("p.c", 0.4))}
        else {_oklab(_scaled("p.a", 1), polar[2], polar[3])} end"""
    color = sql_let("k", channels, _hex("k.r", "k.g", "k.b"))
    alpha = f"if(p.alpha = '', null, least(greatest({_scaled('p.alpha', 1.0)}, 0D), 1D))"
    state = f"struct({raw} as t, {raw} rlike r'{LEGACY}' as legacy)"
    known = f"s.legacy or s.t rlike r'{MODERN}'"
    return sql_let(
        "s", state, f"if({known}, {sql_let('p', parts, _color(color, alpha))}, null)"
    )


def color_sql(raw: str) -> str:
    """Any CSS colour to struct(color, alpha); null when it cannot be resolved."""
    return sql_let(
        "c",
        f"trim({BLANKS_SQL} from {raw})",
        f"""case when startswith(c, '#') then {hex_sql("c")}
        when lower(c) = 'transparent' then {_color("'#000000'", "0")}
        when contains(c, '(') then {function_sql("c")}
        else {named_sql("c")} end""",
    )


def lab65_sql(color: str) -> str:
    """``#rrggbb`` to struct(l, a, b) in CIELAB under D65."""
    rgb = _linear_rgb_sql(color)
    white = [tuple(k / w for k in row) for row, w in zip(RGB_TO_XYZ65, D65, strict=True)]
    xyz = _matrix(tuple(white), ("v.r", "v.g", "v.b"), "xyz")

    def f(t: str) -> str:
        return f"if({t} > {LAB_E}D, cbrt({t}), ({LAB_K}D * {t} + 16) / 116)"

    bent = f"struct({', '.join(f'{f(f"w.{c}")} as {c}' for c in 'xyz')})"
    lab = "struct(116 * u.y - 16 as l, 500 * (u.x - u.y) as a, 200 * (u.y - u.z) as b)"
    return sql_let("v", rgb, sql_let("w", xyz, sql_let("u", bent, lab)))


def _linear_rgb_sql(color: str) -> str:
    def channel(i: int) -> str:
        x = f"(cast(conv(substring({color}, {i}, 2), 16, 10) as double) / 255)"
        return f"if({x} <= 0.04045D, {x} / 12.92D, pow(({x} + 0.055D) / 1.055D, 2.4D))"

    return f"struct({channel(2)} as r, {channel(4)} as g, {channel(6)} as b)"


def chroma_sql(color: str) -> str:
    lms = _matrix(RGB_TO_LMS, ("v.r", "v.g", "v.b"), "lms")
    cone = ("cbrt(w.l)", "cbrt(w.m)", "cbrt(w.s)")
    chroma = f"hypot({_dot(LMS_TO_OKLAB[1], cone)}, {_dot(LMS_TO_OKLAB[2], cone)})"
    return sql_let("v", _linear_rgb_sql(color), sql_let("w", lms, chroma))


def delta_e_steps(p: str, q: str) -> list[dict[str, str]]:
    """CIEDE2000 between two Lab structs, as rounds of named values ending in ``delta_e``.

    Each round only uses names of the rounds before it.
    """

    def tail(c: str) -> str:
        seventh = " * ".join([c] * 7)
        return f"sqrt({seventh} / ({seventh} + {25.0**7}D))"

    def hue(a: str, b: str) -> str:
        return f"if({a} = 0 and {b} = 0, 0D, pmod(degrees(atan2({b}, {a})), 360D))"

    def cosd(deg: str) -> str:
        return f"cos(radians({deg}))"

    return [
        {"de_c": f"(hypot({p}.a, {p}.b) + hypot({q}.a, {q}.b)) / 2"},
        {"de_g": f"1.5D - 0.5D * {tail('de_c')}"},
        {"de_a1": f"{p}.a * de_g", "de_a2": f"{q}.a * de_g"},
        {
            "de_c1": f"hypot(de_a1, {p}.b)",
            "de_c2": f"hypot(de_a2, {q}.b)",
            "de_h1": hue("de_a1", f"{p}.b"),
            "de_h2": hue("de_a2", f"{q}.b"),
        },
        {"de_gap": "de_h2 - de_h1", "de_sum": "de_h1 + de_h2", "de_grey": "de_c1 * de_c2 = 0"},
        {
            "de_turn": "case when de_grey then 0D when de_gap > 180 then de_gap - 360 "
            "when de_gap < -180 then de_gap + 360 else de_gap end",
            "de_mh": "case when de_grey then de_sum when abs(de_gap) <= 180 then de_sum / 2 "
            "when de_sum < 360 then (de_sum + 360) / 2 else (de_sum - 360) / 2 end",
            "de_mc": "(de_c1 + de_c2) / 2",
            "de_ml": f"(({p}.l + {q}.l) / 2 - 50) * (({p}.l + {q}.l) / 2 - 50)",
        },
        {
            "de_t": f"1 - 0.17D * {cosd('de_mh - 30')} + 0.24D * {cosd('2 * de_mh')} "
            f"+ 0.32D * {cosd('3 * de_mh + 6')} - 0.20D * {cosd('4 * de_mh - 63')}",
            "de_x": f"({q}.l - {p}.l) / (1 + 0.015D * de_ml / sqrt(20 + de_ml))",
            "de_y": "(de_c2 - de_c1) / (1 + 0.045D * de_mc)",
            "de_r": f"-2 * {tail('de_mc')} * "
            "sin(radians(60 * exp(-pow((de_mh - 275) / 25, 2D))))",
        },
        {
            "de_z": "2 * sqrt(de_c1 * de_c2) * sin(radians(de_turn / 2)) "
            "/ (1 + 0.015D * de_mc * de_t)"
        },
        {
            "delta_e": "sqrt(greatest(de_x * de_x + de_y * de_y + de_z * de_z "
            "+ de_r * de_y * de_z, 0D))"
        },
    ]


def delta_e_sql(p: str, q: str) -> str:
    """The same distance as one expression, for use on single pairs."""
    answer = "s9.delta_e"
    steps = delta_e_steps("s0.p", "s0.q")
    for k in range(len(steps), 0, -1):
        known = {name: i + 1 for i, step in enumerate(steps[: k - 1]) for name in step}
        fields = []
        for name, sql in steps[k - 1].items():
            text = re.sub(r"\bde_\w+", lambda m, known=known: f"s{known[m[0]]}.{m[0]}", sql)
            fields.append(f"{text} as {name}")
        answer = sql_let(f"s{k}", f"struct({', '.join(fields)})", answer)
    return sql_let("s0", f"struct({p} as p, {q} as q)", answer)


def normalize_color(raw: str) -> Column:
    return F.expr(color_sql(raw))


def lab65(color: str) -> Column:
    return F.expr(lab65_sql(color))


def oklch_chroma(color: str) -> Column:
    return F.expr(chroma_sql(color))


def is_neutral(color: str) -> Column:
    return oklch_chroma(color) < NEUTRAL_CHROMA


def delta_e_lab(p: str, q: str) -> Column:
    return F.expr(delta_e_sql(p, q))


def ciede2000(a: str, b: str) -> Column:
    pair = f"struct({lab65_sql(a)} as p, {lab65_sql(b)} as q)"
    return F.expr(sql_let("k", pair, delta_e_sql("k.p", "k.q")))
