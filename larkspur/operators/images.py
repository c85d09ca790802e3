"""Statistics, enhancement and scaling of images from Spark's ``image`` source, in numpy over Arrow batches.

Images are handled one at a time, so a task holds one image and what is made of it. Grey images stay
grey; others are read as red, green and blue, without transparency. Arithmetic is on 8-bit samples: blends
cut off fractions, kernels leave the border as it is, and scaling rounds after each axis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..registry import operator


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(height, width, 3) samples; the source stores blue first."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def grey(x: np.ndarray) -> np.ndarray:
    """One channel of 8-bit luma."""
    if x.shape[2] == 1:
        return x[:, :, 0]
    return ((x.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def colourfulness(x: np.ndarray, wrap: bool = True) -> float:
    """Spread and mean of the opponent colours; ``wrap`` keeps 8-bit differences modulo 256."""
    kind = np.uint8 if wrap else np.float64
    r, g, b = (x[:, :, i].astype(kind) for i in range(3))
    rg = np.abs((r - g).astype(np.float64))
    yb = np.abs(0.5 * (r + g).astype(np.float64) - b)
    return round(float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())), 2)


def hsv(x: np.ndarray) -> np.ndarray:
    """Hue, saturation and value in 0 .. 255, in single precision as usual."""
    c = x.astype(np.float32)
    most, least = c.max(axis=2), c.min(axis=2)
    span = np.where(most > least, most - least, np.float32(1))
    part = (most[:, :, None] - c) / span[:, :, None]
    turn = np.select([c[:, :, 0] == most, c[:, :, 1] == most], [part[:, :, 2] - part[:, :, 1], 2 + part[:, :, 0] - part[:, :, 2]],
        4 + part[:, :, 1] - part[:, :, 0])
    hue = np.where(most > least, ((turn.astype(np.float64) / 6 + 1) % 1).astype(np.float32).astype(np.float64) * 255, 0)
    saturation = np.where(most > least, ((most - least) / np.where(most > 0, most, np.float32(1))).astype(np.float64) * 255, 0)
    return np.stack([hue, saturation, most], axis=2).astype(np.int64)


def stats(x: np.ndarray) -> dict:
    luma = x @ np.array([0.299, 0.587, 0.114])
    h, w = x.shape[:2]
    d = int(np.gcd(h, w)) or 1
    cells, n = np.unique((x // 32 * 32).reshape(-1, 3), axis=0, return_counts=True)
    top = sorted(zip((-n).tolist(), cells.tolist()))[:5]
    tones = hsv(x).reshape(-1, 3)
    flat = x.reshape(-1, 3)
    return {
        "width": w, "height": h, "megapixels": round(w * h / 1e6, 2), "aspect": f"{w // d}:{h // d}",
        "mean": flat.mean(axis=0).tolist(), "std": flat.std(axis=0).tolist(), "least": flat.min(axis=0).tolist(), "most": flat.max(axis=0).tolist(),
        "brightness": float(luma.mean()), "contrast": float(luma.std()), "colourfulness": colourfulness(x), "dominant": [hex_colour(c) for _, c in top],
        "histogram": np.bincount(np.rint(luma).astype(int).ravel() // 16, minlength=16).tolist(),
        "hsv_mean": [round(float(v), 2) for v in tones.mean(axis=0)], "hsv_std": [round(float(v), 2) for v in tones.std(axis=0)],
    }


def hex_colour(c: list[int]) -> str:
    return "#%02x%02x%02x" % tuple(c)


_STATS = (
    "origin string, width int, height int, megapixels double, aspect string, mean array<double>, std array<double>, least array<long>, "
    "most array<long>, brightness double, "
    "contrast double, colourfulness double, dominant array<string>, histogram array<long>, hsv_mean array<double>, hsv_std array<double>")


def each_image(images: DataFrame, fn: Callable[[str, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each image's origin and samples (one channel or three); unreadable images make none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, h, w, c, data = (col[i].as_py() for col in batch.columns)
                if h and w and h > 0 and w > 0:
                    x = rgb(h, w, c, data)
                    for row in fn(origin, x[:, :, :1] if c == 1 else x):
                        yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, kinds)], schema=kinds)

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, schema)


@operator(category="images")
def image_stats(images: DataFrame) -> DataFrame:
    """Size, channel and HSV statistics, colourfulness, dominant colours and a grey histogram of each image."""
    return each_image(images, lambda origin, x: iter([(origin, *stats(x if x.shape[2] == 3 else np.repeat(x, 3, axis=2)).values())]), _STATS)


#: The kernels of the filters (weights, divisor, what is added).
KERNELS = {
    "sharpen": ([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]], 16, 0),
    "blur": ([[1, 1, 1, 1, 1], [1, 0, 0, 0, 1], [1, 0, 0, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]], 16, 0),
    "edge_enhance": ([[-1, -1, -1], [-1, 10, -1], [-1, -1, -1]], 2, 0),
    "smooth": ([[1, 1, 1], [1, 5, 1], [1, 1, 1]], 13, 0),
    "emboss": ([[0, 0, 0], [0, 1, 0], [-1, 0, 0]], 1, 128),
    "find_edges": ([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], 1, 0),
}


def convolve(x: np.ndarray, kernel: str) -> np.ndarray:
    """A filter of ``KERNELS``; samples whose neighbourhood is cut by the border stay."""
    weights, by, add = KERNELS[kernel]
    k, (h, w) = len(weights) // 2, x.shape[:2]
    out = x.copy()
    if h > 2 * k and w > 2 * k:
        inner = sum(weights[i][j] * x[i : h - 2 * k + i,
                j : w - 2 * k + j].astype(np.float64) for i in range(2 * k + 1) for j in range(2 * k + 1) if weights[i][j])
        out[k : h - k, k : w - k] = np.clip(np.floor(inner / by + add + 0.5), 0, 255).astype(np.uint8)
    return out


def blend(base: np.ndarray | float, x: np.ndarray, by: float) -> np.ndarray:
    """From ``base`` towards ``x`` and, beyond 1, further; fractions are cut off."""
    return np.clip(np.trunc(base + by * (x.astype(np.float64) - base)), 0, 255).astype(np.uint8)


def _per_channel(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """``fn`` makes a table of 256 values of each channel's histogram."""
    return lambda x: np.stack([np.clip(fn(np.bincount(x[:, :, c].ravel(), minlength=256)), 0, 255).astype(np.uint8)[x[:, :,
                    c]] for c in range(x.shape[2])], axis=2)


def _stretched(histogram: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(histogram)
    low, high = used[0], used[-1]
    return np.trunc((np.arange(256) - low) * (255.0 / (high - low))) if high > low else np.arange(256)


def _equalized(histogram: np.ndarray) -> np.ndarray:
    used = histogram[histogram > 0]
    step = int(used[:-1].sum()) // 255
    return (step // 2 + np.concatenate([[0], np.cumsum(histogram)[:-1]])) // step if step else np.arange(256)


def _median(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return np.median(np.stack([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def _greyed(x: np.ndarray) -> np.ndarray:
    return np.repeat(grey(x)[:, :, None], x.shape[2], axis=2)


def _sharpness(x: np.ndarray, by: float) -> np.ndarray:
    return blend(convolve(x, "smooth").astype(np.float64), x, by)


def _auto(x: np.ndarray, by: float) -> np.ndarray:
    out = _sharpness(_per_channel(_stretched)(x), 1.2)
    return blend(_greyed(out).astype(np.float64), out, 1.1) if x.shape[2] == 3 else out


#: Operations on samples and an intensity.
ENHANCE: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {"contrast": lambda x, by: blend(float(int(grey(x).mean() + 0.5)), x, by),
    "brightness": lambda x, by: blend(0.0, x, by), "sharpness": _sharpness, "color": lambda x, by: blend(_greyed(x).astype(np.float64), x,
        by), "auto_contrast": lambda x, by: _per_channel(_stretched)(x), "auto_color": lambda x, by: _greyed(x), "denoise": lambda x,
    by: _median(x), **{name: (lambda x, by, name=name: convolve(x, name)) for name in KERNELS}, "grayscale": lambda x, by: grey(x)[:, :,
        None], "sepia": lambda x, by: np.clip(np.rint(x @ np.array([[0.393, 0.349, 0.272], [0.769, 0.686, 0.534], [0.189, 0.168, 0.131]])),
        0, 255).astype(np.uint8) if x.shape[2] == 3 else x, "invert": lambda x, by: 255 - x, "equalize": lambda x,
    by: _per_channel(_equalized)(x), "auto_enhance": _auto,}

#: What the number of improved measures is called.
RATINGS = ("minimal", "moderate", "significant")


def improvement(before: np.ndarray, after: np.ndarray) -> tuple[float | None, float | None, int, str]:
    """Change of contrast (grey images) and of colourfulness (others) in percent, and how many of them rise."""
    change = lambda a, b: round((b - a) / a * 100, 2) if a > 0 else 0.0
    both_grey, both_colour = before.shape[2] == after.shape[2] == 1, before.shape[2] == after.shape[2] == 3
    contrast = change(float(before.std()), float(after.std())) if both_grey else None
    colour = change(colourfulness(before), colourfulness(after)) if both_colour else None
    score = sum(1 for v in (contrast, colour) if v is not None and v > 0)
    return contrast, colour, score, RATINGS[score]


def renamed(origin: str, suffix: str, extension: str | None = None) -> str:
    """The path with a suffix before its extension."""
    folder, slash, name = origin.rpartition("/")
    stem, dot, old = name.rpartition(".")
    return f"{folder}{slash}{stem if dot else name}{suffix}" + ("." + extension.lower() if extension else dot + old if dot else "")


def _stored(x: np.ndarray) -> tuple[int, int, int, bytes]:
    return x.shape[0], x.shape[1], x.shape[2], (x if x.shape[2] == 1 else x[:, :, ::-1]).tobytes()


@operator(category="images")
def enhance(images: DataFrame, operations: list[str], intensity: float = 1.2) -> DataFrame:
    """origin, output, applied, height, width, channels, data (blue first) and the improvement of each image.

    Operations of ``ENHANCE`` are applied in order; unknown ones are left out. The output's name has the first three.
    """
    known = [o for o in operations if o in ENHANCE]

    def one(origin: str, x: np.ndarray) -> Iterator[tuple]:
        out = x
        for o in known:
            out = ENHANCE[o](out, intensity)
        yield (origin, renamed(origin, "_enhanced_" + "_".join(operations[:3])), known, *_stored(out), *improvement(x, out))

    return each_image(images, one,
        "origin string, output string, applied array<string>, height int, width int, channels int, data binary, contrast_change_percent "
        "double, colourfulness_change_percent double, improvement_score int, improvement_rating string")


def _triangle(t: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(t), 0)


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, (((t - 5) * t + 8) * t - 4) * a, 0))


def _lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)


#: Kernels of scaling methods and how many samples they reach to either side.
SCALERS = {"bilinear": (_triangle, 1.0), "bicubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def weights(n: int, factor: int, method: str) -> np.ndarray:
    """(n * factor, n): what each sample gives to each scaled one; rows sum to 1."""
    kernel, reach = SCALERS[method]
    centre = (np.arange(n * factor) + 0.5) / factor
    at = np.arange(n)[None, :]
    inside = (at >= np.trunc(np.maximum(centre - reach + 0.5, 0))[:, None]) & (at < np.trunc(np.minimum(centre + reach + 0.5, n))[:, None])
    w = np.where(inside, kernel(at + 0.5 - centre[:, None]), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, factor: int, method: str = "lanczos") -> np.ndarray:
    """``factor`` times as wide and high."""
    if method == "nearest":
        return np.repeat(np.repeat(x, factor, axis=0), factor, axis=1)
    across = np.clip(np.rint(np.einsum("ij,hjc->hic", weights(x.shape[1], factor, method), x.astype(np.float64))), 0, 255)
    return np.clip(np.rint(np.einsum("ij,jwc->iwc", weights(x.shape[0], factor, method), across)), 0, 255).astype(np.uint8)


@operator(category="images")
def upscale(images: DataFrame, factors: list[int] | None = None, methods: list[str] | None = None, extension: str | None = None) -> DataFrame:
    """One row for each image, method and factor (2 to 8): origin, output, method, factor, height, width, channels, data and the growth of pixels.

    Several methods and factors compare them on the same images.
    """
    pairs = [(m, f) for m in (methods or ["lanczos"]) for f in (factors or [2])]
    if any(m not in (*SCALERS, "nearest") or not 2 <= f <= 8 for m, f in pairs):
        raise ValueError("methods are nearest, bilinear, bicubic and lanczos, factors 2 to 8")

    def one(origin: str, x: np.ndarray) -> Iterator[tuple]:
        for m, f in pairs:
            yield (origin, renamed(origin, f"_x{f}", extension), m, f, *_stored(resize(x, f, m)), float(f * f))

    return each_image(images, one,
        "origin string, output string, method string, factor int, height int, width int, channels int, data binary, pixel_growth double")


@operator(category="images")
def image_steps(images: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Steps one after the other on each image: origin, index, step, status, error, and the size and samples that it leaves.

    A step is an operation of ``ENHANCE`` (intensity) or ``upscale`` (factor, method). One that fails leaves
    the image as it was, and the next goes on from there.
    """

    def one(origin: str, x: np.ndarray) -> Iterator[tuple]:
        for i, (step, params) in enumerate(steps):
            status, error = "success", None
            try:
                if step == "upscale":
                    x = resize(x, int(params.get("factor", 2)), params.get("method", "lanczos"))
                else:
                    x = ENHANCE[step](x, float(params.get("intensity", 1.2)))
            except KeyError as e:
                status, error = "failed", f"Tool not found: {e.args[0]}"
            except (TypeError, ValueError) as e:
                status, error = "failed", str(e)
            yield (origin, i, step, status, error, *_stored(x))

    return each_image(images, one, "origin string, index int, step string, status string, error string, height int, width int, channels int, data binary")


#: What a quality band counts in a batch's mean.
QUALITY_SCORES = {"excellent": 4, "good": 3, "fair": 2, "poor": 1}


@operator(category="images")
def image_batch(results: DataFrame) -> DataFrame:
    """Of (success, megapixels, quality): images, successes, failures, megapixels in all and the mean quality score (0 without successes)."""
    ok = F.coalesce("success", F.lit(False))
    score = F.lit(1)
    for name, value in QUALITY_SCORES.items():
        score = F.when(F.col("quality") == name, value).otherwise(score)
    return results.agg(F.count(F.lit(1)).alias("total_images"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("megapixels"))), F.lit(0.0)).alias("total_megapixels"), F.coalesce(F.avg(F.when(ok, score)),
            F.lit(0.0)).alias("average_quality_score"),)


@operator(category="images")
def quality_band(measures: DataFrame) -> DataFrame:
    """Score 0 to 8 and band of (bpp, mp, sharp, noise): bits a pixel, megapixels, sharpness and noise. The thresholds are fixed values."""
    high = lambda c, good, fair: F.when(F.col(c) > good, 2).when(F.col(c) > fair, 1).otherwise(0)
    calm = F.when(F.col("noise") < 5, 2).when(F.col("noise") < 10, 1).otherwise(0)
    score = high("bpp", 2, 1) + high("mp", 8, 2) + high("sharp", 10, 5) + calm
    band = F.when(F.col("score") >= 6, "excellent").when(F.col("score") >= 4, "good").when(F.col("score") >= 2, "fair").otherwise("poor")
    return measures.withColumn("score", score.cast("long")).withColumn("band", band)
