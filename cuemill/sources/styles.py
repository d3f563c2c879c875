"""Styles of ASS scripts: options, presets, colour schemes, style lines, CSS, and repairs of broken lines."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import kinetic

# Fields each preset sets.
PRESETS = {
    "classic": {"font_name": "Arial", "font_size": 64, "bold": False, "primary_color": "#FFFFFF", "background_color": "#000000CC", "outline_width": 16, "shadow_depth": 0, "alignment": 2, "margin_v": 80},
    "tiktok": {"font_name": "Arial Black", "font_size": 80, "bold": True, "outline_color": "#000000", "outline_width": 3.0, "shadow_depth": 2.0, "borderstyle": 1, "alignment": 5, "margin_v": 0, "spacing": 1.5, "karaoke_effect": "instant", "karaoke_color_scheme": "yellow-pop", "kinetic_style": "spotlight"},
    "modern_box": {"font_name": "Helvetica", "font_size": 58, "bold": True, "primary_color": "#000000", "background_color": "#FFFFFFFF", "outline_width": 16, "shadow_depth": 3.0, "alignment": 2, "margin_v": 80},
    "cinematic": {"font_name": "Helvetica Neue", "font_size": 48, "bold": False, "italic": True, "primary_color": "#FFFFFFE6", "outline_color": "#000000", "outline_width": 0, "shadow_depth": 4.0, "spacing": 4.0, "borderstyle": 1, "alignment": 2, "margin_v": 120},
    "outline": {"font_name": "Arial Black", "font_size": 64, "bold": True, "primary_color": "#FFFFFF", "outline_color": "#000000", "outline_width": 1.5, "shadow_depth": 1.0, "borderstyle": 1, "alignment": 2, "margin_v": 60},
    "bold_center": {"font_name": "Arial Black", "font_size": 100, "bold": True, "primary_color": "#FFFFFF", "outline_color": "#00000099", "outline_width": 1.5, "shadow_depth": 4.0, "borderstyle": 1, "alignment": 5, "margin_v": 0, "wrap_style": 2, "karaoke_effect": "instant", "kinetic_style": "reveal"},
}
# Primary, secondary, outline and back colour and outline width of karaoke schemes.
SCHEMES = {
    "azure-gold": ("#FFC209", "#FFFFFF", "#1387C0", "#0A3D5C", 0.0),
    "sakura-purple": ("#F7C3D9", "#7953B1", "#063C85", "#1A1A2E", 0.0),
    "mint-ocean": ("#A1FEEF", "#658AE4", "#28314E", "#0A0A1A", 0.0),
    "gardenia-green": ("#FFFFFF", "#9DC92A", "#77964A", "#1C2B1A", 0.0),
    "sunset-warm": ("#FAEDD1", "#F4520D", "#1387C0", "#0A1628", 0.0),
    "prussian-elegant": ("#FFFFFF", "#FBC03D", "#003153", "#001A2C", 0.0),
    "burgundy-classic": ("#F7F2DF", "#CC5D84", "#800020", "#2A000D", 0.0),
    "langgan-spring": ("#C1D796", "#CC5D84", "#8A3A5A", "#2A1020", 0.0),
    "mars-teal": ("#FFFFFF", "#008C8C", "#003153", "#001A1A", 0.0),
    "spring-field": ("#FBFFF2", "#46B065", "#008E6B", "#0A2A1A", 0.0),
    "navy-pink": ("#FFFFFF", "#F7C3D9", "#063C85", "#021A3A", 0.0),
    "apricot-dark": ("#FEA72E", "#F7F2DF", "#3A3C50", "#1A1A28", 0.0),
    "yellow-pop": ("#FACC15", "#FFFFFF", "#000000", "#000000", 3.0),
}
SCHEME_FIELDS = ("primary_color", "secondary_color", "outline_color", "back_color", "outline_width")
BOX_PADDING = 4
STYLE_FORMAT = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"


@dataclass(frozen=True)
class ASSConfig:
    """Look of a script; a preset fills the fields that are still at their default."""

    font_name: str = "Arial"
    font_size: int = 64
    primary_color: str = "#FFFFFF"
    secondary_color: str = "#00FFFF"
    outline_color: str = "#000000"
    back_color: str = "#000000"
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strikeout: bool = False
    scalex: float = 100.0
    scaley: float = 100.0
    spacing: float = 0.0
    angle: float = 0.0
    background_color: str = ""
    borderstyle: int | None = None
    outline_width: float = 0
    shadow_depth: float = 1.0
    alignment: int = 2
    margin_l: int = 20
    margin_r: int = 20
    margin_v: int = 20
    play_res_x: int = 1920
    play_res_y: int = 1080
    scaled_border_and_shadow: bool = True
    wrap_style: int = 0
    speaker_color: str = ""
    karaoke_effect: str | None = None
    karaoke_color_scheme: str = ""
    translation_color: str | None = None
    kinetic_style: str | None = None
    style_preset: str | None = None

    def __post_init__(self) -> None:
        if self.style_preset is not None:
            if self.style_preset not in PRESETS:
                raise ValueError(f"no style preset {self.style_preset!r}: one of {', '.join(PRESETS)}")
            defaults = {f.name: f.default for f in fields(self)}
            for name, value in PRESETS[self.style_preset].items():
                if getattr(self, name) == defaults[name]:
                    object.__setattr__(self, name, value)
        kinetic.check(self.kinetic_style)
        if self.karaoke_effect not in (None, "sweep", "instant", "outline"):
            raise ValueError(f"no karaoke effect {self.karaoke_effect!r}")


def with_scheme(config: ASSConfig, scheme: str) -> ASSConfig:
    """The colours of a scheme; an unknown one changes nothing."""
    found = SCHEMES.get(scheme.lower().strip())
    return replace(config, style_preset=None, **dict(zip(SCHEME_FIELDS, found, strict=True))) if found else config


def schemes(spark: SparkSession) -> DataFrame:
    """The schemes as a table of a dozen rows, to be joined by name."""
    return spark.createDataFrame([(k, *v) for k, v in SCHEMES.items()], "scheme string, primary_color string, secondary_color string, outline_color string, back_color string, outline_width double")


def presets(spark: SparkSession) -> DataFrame:
    """What each preset makes of the defaults."""
    looks = [(k, ASSConfig(style_preset=k)) for k in PRESETS]
    return spark.createDataFrame(
        [(k, c.font_name, c.font_size, c.bold, c.italic, c.primary_color, c.background_color, float(c.outline_width), float(c.shadow_depth), c.alignment, c.margin_v, c.karaoke_effect, c.kinetic_style) for k, c in looks],
        "preset string, font_name string, font_size int, bold boolean, italic boolean, primary_color string, background_color string, outline_width double, shadow_depth double, alignment int, margin_v int, karaoke_effect string, kinetic_style string",
    )


def ass_color(rgb: str) -> str:
    """``#RRGGBB`` or ``#RRGGBBAA`` as ``&HAABBGGRR``; alpha is inverted."""
    c = rgb.lstrip("#").upper()
    if len(c) not in (6, 8) or set(c) - set("0123456789ABCDEF"):
        raise ValueError(f"no colour: {rgb!r}")
    alpha = 255 - int(c[6:] or "FF", 16)
    return f"&H{alpha:02X}{c[4:6]}{c[2:4]}{c[:2]}"


def border(config: ASSConfig) -> tuple[int, str, float, float]:
    """(border style, outline colour, outline, shadow): a background makes a box, whose padding is the outline and which throws no shadow."""
    style = config.borderstyle if config.borderstyle is not None else 3 if config.background_color else 1
    fill = config.background_color if style == 3 and config.background_color else config.outline_color
    if style != 3:
        return style, ass_color(fill), config.outline_width, config.shadow_depth
    return style, ass_color(fill), config.outline_width if config.outline_width > 0 else BOX_PADDING, 0


def style_line(config: ASSConfig, name: str = "Default") -> str:
    style, outline, width, shadow = border(config)
    flag = lambda on: "-1" if on else "0"
    values = (
        name, config.font_name, f"{config.font_size:g}", ass_color(config.primary_color), ass_color(config.secondary_color), outline, ass_color(config.back_color),
        flag(config.bold), flag(config.italic), flag(config.underline), flag(config.strikeout), f"{config.scalex:g}", f"{config.scaley:g}", f"{config.spacing:g}", f"{config.angle:g}",
        style, f"{width:g}", f"{shadow:g}", config.alignment, config.margin_l, config.margin_r, config.margin_v, 1,
    )
    return "Style: " + ",".join(map(str, values))


# ---- columns


def css_color(ass: Column) -> Column:
    """``&HAABBGGRR`` as ``#RRGGBB`` where it is opaque, else ``rgba``."""
    c = F.lpad(F.regexp_replace(ass, "^&[Hh]", ""), 8, "0")
    part = lambda k: F.conv(F.substring(c, k, 2), 16, 10).cast("int")
    alpha = F.round(1 - part(1) / 255.0, 2)
    seen = F.concat(F.lit("rgba("), F.concat_ws(",", part(7).cast("string"), part(5).cast("string"), part(3).cast("string"), alpha.cast("string")), F.lit(")"))
    return F.when(part(1) > 0, seen).otherwise(F.concat(F.lit("#"), F.substring(c, 7, 2), F.substring(c, 5, 2), F.substring(c, 3, 2)))


def css_block(style: Column) -> Column:
    """``STYLE`` block of WebVTT for a default style: struct of ``fontname, bold, italic, primarycolor, outlinecolor, borderstyle, outline``."""
    field = lambda name: style[name]
    line = lambda key, value: F.concat(F.lit(f"  {key}: "), value, F.lit(";"))
    box = (F.coalesce(field("borderstyle"), F.lit(1)) == 3) & field("outlinecolor").isNotNull()
    stroke = css_color(field("outlinecolor"))
    width = F.greatest(F.lit(1), F.bround(field("outline")).cast("int")).cast("string")
    shadow = F.concat(F.lit("-"), width, F.lit("px 0 "), stroke, F.lit(", "), width, F.lit("px 0 "), stroke, F.lit(", 0 -"), width, F.lit("px "), stroke, F.lit(", 0 "), width, F.lit("px "), stroke)
    props = (
        line("font-family", field("fontname")),
        F.when(field("bold"), "  font-weight: bold;"),
        F.when(field("italic"), "  font-style: italic;"),
        line("color", css_color(field("primarycolor"))),
        F.when(box, line("background-color", stroke)).otherwise("  background-color: transparent;"),
        F.when(box, "  text-shadow: none;").when((field("outline") > 0) & field("outlinecolor").isNotNull(), line("text-shadow", shadow)),
    )
    return F.concat_ws("\n", F.lit("STYLE"), F.lit("::cue {"), *props, F.lit("}"))


def repair_stamp(stamp: Column) -> Column:
    """A stamp with a negative minute or second becomes zero; a sign in front is left to the reader."""
    s = F.trim(stamp)
    negative = s.rlike("^\\d+:-?\\d+:-?\\d+(?:\\.\\d+)?$") & s.rlike(":-") & ~s.rlike("^\\d+:(?:-0+:-?0+(?:\\.0+)?|0*\\d+:-0+(?:\\.0+)?)$")
    return F.when(negative, "0:00:00.00").otherwise(stamp)


def repair_color(color: Column) -> Column:
    """Stray ``H`` inside a colour are dropped if six or eight digits are left."""
    s = F.trim(color)
    body = F.regexp_replace(F.substring(s, 3, 1 << 20), "[Hh]", "")
    stray = s.rlike("^&[Hh].*[Hh]") & body.rlike("^(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")
    return F.when(stray, F.concat(F.lit("&H"), F.upper(body))).otherwise(color)


def repair_line(line: Column) -> Column:
    """Stamps of an event line and colours of a style line repaired; any other line comes back as it is."""
    head = F.regexp_extract(line, "^([^:]*:\\s*)", 1)
    rest = F.substring(line, F.length(head) + 1, F.length(line))

    def fixed(parts: Column, places: tuple[int, ...], repair) -> Column:
        return F.concat(head, F.array_join(F.transform(parts, lambda x, i: F.when(i.isin(*places), repair(x)).otherwise(x)), ","))

    events, styles = F.split(rest, ",", 10), F.split(rest, ",", -1)
    return (
        F.when(line.rlike("^(?:Dialogue|Comment):") & (F.size(events) >= 3), fixed(events, (1, 2), repair_stamp))
        .when(line.rlike("^Style:") & (F.size(styles) > 6), fixed(styles, (3, 4, 5, 6), repair_color))
        .otherwise(line)
    )


def repair_script(content: Column) -> Column:
    """A whole script with every line repaired."""
    return F.array_join(F.transform(F.split(content, "\n", -1), repair_line), "\n")


def tag_prefix(raw: Column) -> Column:
    """Override blocks at the beginning of a text."""
    return F.regexp_extract(raw, "^((?:\\{[^}]*\\})*)", 1)


def _bare(text: Column) -> Column:
    out = F.replace(F.regexp_replace(text, "\\{[^}]*\\}", ""), F.lit("\\N"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, "(?U)[\\s&&[^\\n]]+", " "), " *\\n *", "\n")
    return F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")


def event_text(text: Column, raw: Column) -> Column:
    """Text of an event: the raw one where only tags and blanks differ, else the new one with the raw one's leading tags and last breaks."""
    plain = F.replace(text, F.lit("\n"), F.lit("\\N"))
    breaks = F.regexp_extract(raw, "((?:\\\\N)+)\\s*$", 1)
    changed = F.concat(tag_prefix(raw), plain)
    return F.when(F.coalesce(raw, F.lit("")) == "", plain).when(_bare(raw) == _bare(text), raw).otherwise(F.when((breaks != "") & ~F.endswith(changed, breaks), F.concat(changed, breaks)).otherwise(changed))


def splice_event(new: Column, raw: Column) -> Column:
    """An event line's fields: times from the new one, name and text from the raw one if only trailing blanks differ, the rest raw."""
    a, b = F.split(new, ",", 10), F.split(raw, ",", 10)
    same = lambda k: F.rtrim(F.get(a, F.lit(k))) == F.rtrim(F.get(b, F.lit(k)))
    field = lambda k: F.get(a, F.lit(k)) if k in (1, 2) else F.when(same(k), F.get(b, F.lit(k))).otherwise(F.get(a, F.lit(k))) if k in (4, 9) else F.get(b, F.lit(k))
    return F.when((F.size(a) == 10) & (F.size(b) == 10), F.concat_ws(",", *(field(k) for k in range(10)))).otherwise(new)


def zip_raw(cues: DataFrame, raws: DataFrame, doc: str = "doc_id", position: str = "cue_idx") -> DataFrame:
    """Raw bodies by position as ``raw``; a document whose numbers differ gets none."""
    here, there = cues.groupBy(doc).agg(F.count("*").alias("__a")), raws.groupBy(doc).agg(F.count("*").alias("__b"))
    equal = here.join(there, doc).where("__a = __b").select(doc)
    return cues.join(raws.join(equal, doc, "left_semi").select(doc, position, F.col("body").alias("raw")), [doc, position], "left")


def missing_styles(styles: DataFrame, raw_styles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Styles that a document's raw block does not name."""
    return styles.join(raw_styles.select(doc, "name").distinct(), [doc, "name"], "left_anti")


def first_wins(first: Column, second: Column) -> Column:
    """Union of two maps; where both have a key, the first one's value stays."""
    return F.map_concat(F.map_filter(second, lambda k, _: ~F.array_contains(F.map_keys(first), k)), first)
