"""Colour arithmetic on 'RRGGBB' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands of the colour families, in HSV.
BLACK_V, GREY_V, GREY_S = 0.20, 0.30, 0.25
GREEN_HUE, GREEN_S, GREEN_V = (75.0, 165.0), 0.35, 0.25
RED_HUE, RED_S, RED_V = (15.0, 340.0), 0.50, 0.35
YELLOW_HUE, YELLOW_S, YELLOW_V = (47.5, 68.0), 0.50, 0.85
# Concealment limits.
CONCEAL_LC, EQUAL_LUMINANCE, SAME_COLOUR, MIN_LIGHTNESS, MIN_CHROMA = 12.0, 1.1, 20.0, 40.0, 40.0


def channel(rgb: Column, i: int) -> Column:
    """One channel of the last six digits as 0..255."""
    return F.conv(F.substring(F.right(rgb, F.lit(6)), 2 * i + 1, 2), 16, 10).cast("double")


def with_hsv(df: DataFrame, rgb: str, prefix: str = "") -> DataFrame:
    """Adds hue (degrees), saturation and value."""
    d = df.withColumn("_r", channel(F.col(rgb), 0)).withColumn("_g", channel(F.col(rgb), 1)).withColumn("_b", channel(F.col(rgb), 2))
    d = d.withColumn("_mx", F.greatest("_r", "_g", "_b")).withColumn("_mn", F.least("_r", "_g", "_b"))
    d = d.withColumn("_d", F.col("_mx") - F.col("_mn"))
    hue = (F.when(F.col("_d") == 0, 0.0)
           .when(F.col("_mx") == F.col("_r"), F.pmod((F.col("_g") - F.col("_b")) / F.col("_d"), F.lit(6.0)))
           .when(F.col("_mx") == F.col("_g"), (F.col("_b") - F.col("_r")) / F.col("_d") + 2)
           .otherwise((F.col("_r") - F.col("_g")) / F.col("_d") + 4))
    return (d.withColumn(prefix + "hue", hue * 60)
            .withColumn(prefix + "sat", F.when(F.col("_mx") == 0, 0.0).otherwise(F.col("_d") / F.col("_mx")))
            .withColumn(prefix + "val", F.col("_mx") / 255)
            .drop("_r", "_g", "_b", "_mx", "_mn", "_d"))


def family(h: Column, s: Column, v: Column) -> Column:
    return (F.when((v <= BLACK_V) | ((v <= GREY_V) & (s <= GREY_S)), "black")
            .when((h >= GREEN_HUE[0]) & (h < GREEN_HUE[1]) & (s >= GREEN_S) & (v >= GREEN_V), "green")
            .when(((h < RED_HUE[0]) | (h >= RED_HUE[1])) & (s >= RED_S) & (v >= RED_V), "red")
            .otherwise("other"))


def bright_yellow(h: Column, s: Column, v: Column) -> Column:
    return h.between(*YELLOW_HUE) & (s >= YELLOW_S) & (v >= YELLOW_V)


# Hue bands of the colour names, each (hue below, name); the last name takes the rest.
_DARK = [(30, "dark_red"), (75, "brown"), (150, "dark_green"), (270, "dark_blue"), (330, "dark_purple"), (361, "dark_red")]
_BRIGHT = [(15, "bright_red"), (45, "bright_orange"), (65, "bright_yellow"), (170, "bright_green"), (200, "bright_cyan"),
           (260, "bright_blue"), (310, "bright_purple"), (345, "bright_magenta"), (361, "bright_red")]
_PASTEL = [(15, "pink"), (45, "peach"), (65, "pale_yellow"), (170, "pale_green"), (200, "pale_cyan"), (260, "light_blue"),
           (310, "lavender"), (330, "pale_magenta"), (361, "pink")]
_PLAIN = [(15, "red"), (45, "orange"), (65, "yellow"), (170, "green"), (200, "cyan"), (260, "blue"), (310, "purple"),
          (345, "magenta"), (361, "red")]
_MUTED = [(60, "beige"), (75, "olive"), (150, "olive"), (200, "slate_blue"), (260, "muted_blue"), (361, "muted_purple")]


def _banded(h: Column, bands: list) -> Column:
    out = None
    for limit, name in bands:
        out = F.when(h < limit, name) if out is None else out.when(h < limit, name)
    return out


def colour_name(h: Column, s: Column, v: Column) -> Column:
    return (F.when(s < 0.1, F.when(v < 0.2, "black").when(v > 0.9, "white").otherwise("gray"))
            .when(v < 0.4, _banded(h, _DARK))
            .when(s < 0.4, F.when((h >= 60) & (h < 75) & (v > 0.8), "light_yellow")
                  .when((h >= 200) & (h < 260) & (v > 0.8), "light_blue").otherwise(_banded(h, _MUTED)))
            .when((s > 0.7) & (v > 0.7), _banded(h, _BRIGHT))
            .when((s < 0.7) & (v > 0.7), F.when((h >= 200) & (h < 260) & (s >= 0.55), "blue").otherwise(_banded(h, _PASTEL)))
            .otherwise(_banded(h, _PLAIN)))


# The scale on which tints are applied, hue, lightness and saturation alike.
HLS = 240


def with_tint(df: DataFrame, rgb: str, tint: str, out: str = "tinted") -> DataFrame:
    """Lightens or darkens a colour as a spreadsheet shows it: whole numbers on a scale of 0..240.

    Below zero the lightness shrinks by the tint, above it moves towards 240; a tint beyond one is one, and no
    tint leaves the colour. Every division drops its rest, after half the divisor was added where that rounds.
    """
    c = F.col

    def rounded(top: Column, by: Column) -> Column:
        return F.floor((top + F.floor(by / 2)) / by)

    d = df
    for i, ch in enumerate("rgb"):
        d = d.withColumn(f"_{ch}", channel(c(rgb), i).cast("long"))
    d = d.withColumn("_mx", F.greatest("_r", "_g", "_b")).withColumn("_mn", F.least("_r", "_g", "_b"))
    d = d.withColumn("_sum", c("_mx") + c("_mn")).withColumn("_d", c("_mx") - c("_mn"))
    d = d.withColumn("_l", F.floor((c("_sum") * HLS + 255) / 510))
    d = d.withColumn("_s", F.when(c("_d") == 0, 0).otherwise(rounded(c("_d") * HLS, F.when(c("_l") <= HLS // 2, c("_sum")).otherwise(510 - c("_sum")))))
    # the share of the way round that each channel lies below the largest
    away = {ch: rounded((c("_mx") - c(f"_{ch}")) * (HLS // 6), F.nullif(c("_d"), F.lit(0))) for ch in "rgb"}
    hue = (F.when(c("_r") == c("_mx"), away["b"] - away["g"]).when(c("_g") == c("_mx"), HLS // 3 + away["r"] - away["b"])
           .otherwise(2 * HLS // 3 + away["g"] - away["r"]))
    d = d.withColumn("_h", hue)
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c(tint)))
    lighter = F.floor(c("_l") * (1 - t) + HLS - F.floor(HLS * (1 - t)))
    d = d.withColumn("_l2", F.greatest(F.lit(0), F.least(F.lit(HLS), F.when(t < 0, F.floor(c("_l") * (1 + t))).otherwise(lighter))))
    d = d.withColumn("_m2", F.when(c("_l2") <= HLS // 2, rounded(c("_l2") * (HLS + c("_s")), F.lit(HLS))).otherwise(c("_l2") + c("_s") - rounded(c("_l2") * c("_s"), F.lit(HLS))))
    d = d.withColumn("_m1", 2 * c("_l2") - c("_m2")).withColumn("_span", c("_m2") - c("_m1"))

    def part(turn: int) -> Column:
        h = c("_h") + turn
        h = F.when(h < 0, h + HLS).when(h > HLS, h - HLS).otherwise(h)
        step = F.lit(HLS // 6)
        level = (F.when(c("_s") == 0, c("_l2")).when(h < HLS // 6, c("_m1") + rounded(c("_span") * h, step)).when(h < HLS // 2, c("_m2"))
                 .when(h < 2 * HLS // 3, c("_m1") + rounded(c("_span") * (2 * HLS // 3 - h), step)).otherwise(c("_m1")))
        value = F.greatest(F.lit(0), F.least(F.lit(255), rounded(level * 255, F.lit(HLS))))
        return F.lpad(F.hex(value.cast("long")), 2, "0")

    same = F.coalesce(c(tint), F.lit(0.0)) == 0
    return (d.withColumn(out, F.when(same, F.upper(c(rgb))).otherwise(F.concat(part(HLS // 3), part(0), part(-HLS // 3))))
            .drop("_r", "_g", "_b", "_mx", "_mn", "_sum", "_l", "_d", "_s", "_h", "_l2", "_m2", "_m1", "_span"))


def _linear(x: Column) -> Column:
    return F.when(x / 255 <= 0.04045, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))


def with_contrast(pairs: DataFrame, text: str = "text_rgb", bg: str = "bg_rgb") -> DataFrame:
    """Adds APCA lightness contrast, WCAG ratio, CIEDE2000 difference and whether the pair conceals.

    Costly arithmetic: call it on distinct colour pairs and join back.
    """
    c, lit = F.col, F.lit
    d = pairs
    for side, rgb in (("1", text), ("2", bg)):
        for i, ch in enumerate("rgb"):
            d = d.withColumn(f"_{ch}{side}", channel(c(rgb), i))
        y = (0.2126729 * F.pow(c(f"_r{side}") / 255, lit(2.4)) + 0.7151522 * F.pow(c(f"_g{side}") / 255, lit(2.4))
             + 0.0721750 * F.pow(c(f"_b{side}") / 255, lit(2.4)))
        d = d.withColumn("_y", y).withColumn(f"_y{side}", F.when(c("_y") > 0.022, c("_y")).otherwise(
            c("_y") + F.pow(F.greatest(0.022 - c("_y"), lit(0.0)), lit(1.414))))
        for ch in "rgb":
            d = d.withColumn(f"_l{ch}", _linear(c(f"_{ch}{side}")))
        d = d.withColumn(f"_w{side}", 0.2126729 * c("_lr") + 0.7151522 * c("_lg") + 0.0721750 * c("_lb"))
        d = d.withColumn("_X", (0.4124564 * c("_lr") + 0.3575761 * c("_lg") + 0.1804375 * c("_lb")) / 0.95047)
        d = d.withColumn("_Z", (0.0193339 * c("_lr") + 0.1191920 * c("_lg") + 0.9503041 * c("_lb")) / 1.08883)

        def f(v: Column) -> Column:
            return F.when(v > 216 / 24389, F.pow(v, lit(1 / 3))).otherwise((24389 / 27 * v + 16) / 116)

        d = d.withColumn("_fx", f(c("_X"))).withColumn("_fy", f(c(f"_w{side}"))).withColumn("_fz", f(c("_Z")))
        d = (d.withColumn(f"_L{side}", 116 * c("_fy") - 16).withColumn(f"_a{side}", 500 * (c("_fx") - c("_fy")))
             .withColumn(f"_k{side}", 200 * (c("_fy") - c("_fz"))))
        d = d.withColumn(f"_C{side}", F.sqrt(c(f"_a{side}") * c(f"_a{side}") + c(f"_k{side}") * c(f"_k{side}")))
    dark = (F.pow(c("_y2"), lit(0.56)) - F.pow(c("_y1"), lit(0.57))) * 1.14
    light = (F.pow(c("_y2"), lit(0.65)) - F.pow(c("_y1"), lit(0.62))) * 1.14
    lc = (F.when(F.abs(c("_y2") - c("_y1")) < 0.0005, 0.0)
          .when(c("_y2") > c("_y1"), F.when(dark < 0.1, 0.0).otherwise(dark - 0.027))
          .otherwise(F.when(light > -0.1, 0.0).otherwise(light + 0.027)))
    d = d.withColumn("lc", F.round(lc * 100, 2))
    d = d.withColumn("wcag", (F.greatest("_w1", "_w2") + 0.05) / (F.least("_w1", "_w2") + 0.05))

    p7 = 25.0 ** 7
    d = d.withColumn("_Cb7", F.pow((c("_C1") + c("_C2")) / 2, lit(7.0)))
    d = d.withColumn("_G", 0.5 * (1 - F.sqrt(c("_Cb7") / (c("_Cb7") + p7))))
    for side in "12":
        d = d.withColumn(f"_ap{side}", (1 + c("_G")) * c(f"_a{side}"))
        d = d.withColumn(f"_cp{side}", F.sqrt(c(f"_ap{side}") * c(f"_ap{side}") + c(f"_k{side}") * c(f"_k{side}")))
        d = d.withColumn(f"_hp{side}", F.when(c(f"_cp{side}") == 0, 0.0).otherwise(
            F.pmod(F.degrees(F.atan2(c(f"_k{side}"), c(f"_ap{side}"))), lit(360.0))))
    grey = c("_cp1") * c("_cp2") == 0
    gap = c("_hp2") - c("_hp1")
    d = d.withColumn("_dh", F.when(grey, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap))
    d = d.withColumn("_dH", 2 * F.sqrt(c("_cp1") * c("_cp2")) * F.sin(F.radians(c("_dh") / 2)))
    total = c("_hp1") + c("_hp2")
    d = d.withColumn("_hb", F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2))
    d = d.withColumn("_Lb", (c("_L1") + c("_L2")) / 2).withColumn("_cb", (c("_cp1") + c("_cp2")) / 2)
    hb = c("_hb")
    d = d.withColumn("_T", 1 - 0.17 * F.cos(F.radians(hb - 30)) + 0.24 * F.cos(F.radians(2 * hb))
                     + 0.32 * F.cos(F.radians(3 * hb + 6)) - 0.20 * F.cos(F.radians(4 * hb - 63)))
    d = d.withColumn("_cb7", F.pow(c("_cb"), lit(7.0)))
    d = d.withColumn("_rt", -F.sin(F.radians(2 * 30 * F.exp(-F.pow((hb - 275) / 25, lit(2.0))))) * 2 * F.sqrt(c("_cb7") / (c("_cb7") + p7)))
    l50 = F.pow(c("_Lb") - 50, lit(2.0))
    d = d.withColumn("_tl", (c("_L2") - c("_L1")) / (1 + 0.015 * l50 / F.sqrt(20 + l50)))
    d = d.withColumn("_tc", (c("_cp2") - c("_cp1")) / (1 + 0.045 * c("_cb")))
    d = d.withColumn("_th", c("_dH") / (1 + 0.015 * c("_cb") * c("_T")))
    square = c("_tl") * c("_tl") + c("_tc") * c("_tc") + c("_th") * c("_th") + c("_rt") * c("_tc") * c("_th")
    d = d.withColumn("de2000", F.sqrt(F.greatest(square, lit(0.0))))
    exempt = ((c("wcag") >= EQUAL_LUMINANCE) & (c("de2000") >= SAME_COLOUR) & (F.least("_L1", "_L2") >= MIN_LIGHTNESS)
              & (F.greatest("_C1", "_C2") >= MIN_CHROMA))
    d = d.withColumn("hue_exempt", exempt).withColumn("conceals", (F.abs("lc") < CONCEAL_LC) & ~exempt)
    return d.select(*pairs.columns, "lc", F.round("wcag", 4).alias("wcag"), F.round("de2000", 4).alias("de2000"), "hue_exempt", "conceals")
