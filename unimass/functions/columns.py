"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import functions as F


def relu(act):
    """max(act, 0)."""
    return F.greatest(act, F.lit(0.0))


def noise_ceiling(ncsnr, trials: int = 3):
    """Noise ceiling in R2 units from the noise-ceiling SNR."""
    return ncsnr * ncsnr / (ncsnr * ncsnr + 1.0 / trials)


def normalize_r2(value, nc, nc_min: float = 0.0):
    """value / max(nc, nc_min) where nc > nc_min, else missing."""
    return F.when(nc > nc_min, F.try_divide(value, F.greatest(nc, F.lit(nc_min))))


def clip_scale(value, lo, hi):
    """(value - lo) / (hi - lo) clipped to 0..1; missing becomes 0."""
    v = F.when(~F.isnan(value), value)
    w = (v - lo) / F.greatest(hi - lo, F.lit(1e-12))
    return F.coalesce(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def quantize(value, scale: float = 300.0):
    """value * scale truncated towards zero as a 16-bit integer (clamped to its range)."""
    v = F.least(F.greatest(value * scale, F.lit(-32768.0)), F.lit(32767.0))
    return v.cast("smallint")


def dequantize(value, scale: float = 300.0):
    return value.cast("double") / scale


def decode_unit(unit, channels: int, height: int, width: int):
    """Columns (channel, y, x) of a flat unit id, missing when it is out of range."""
    ok = (unit >= 0) & (unit < channels * height * width)
    u = F.when(ok, unit)
    size = height * width
    return (F.floor(u / size).alias("channel"), F.floor((u % size) / width).alias("y"),
            (u % width).alias("x"))


def parse_model_name(model, last: bool = False):
    """Columns (arch, weights): split at the first underscore, or at the last one."""
    if last:
        weights = F.substring_index(model, "_", -1)
        arch = F.substring(model, F.lit(1), F.length(model) - F.length(weights) - 1)
    else:
        arch = F.substring_index(model, "_", 1)
        weights = F.substring(model, F.length(arch) + 2, F.length(model))
    return arch.alias("arch"), weights.alias("diet")


def contrast_file_key(contrast):
    """face>object -> face_gt_object."""
    return F.replace(contrast, F.lit(">"), F.lit("_gt_"))


def subject_name(number):
    """1 -> subj01."""
    return F.concat(F.lit("subj"), F.lpad(number.cast("string"), 2, "0"))
