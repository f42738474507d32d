"""The scalar functions under names for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.functions import article, html
from nearpress.functions.distance import pair_size


def _text(f: Callable[[str], str | None]):
    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return apply


def _size(codec: Spec):
    @F.arrow_udf("long")
    def apply(values: pa.Array) -> pa.Array:
        of = codec.make().size
        return pa.array([None if v is None else of(v.encode()) for v in values.to_pylist()], pa.int64())

    return apply


def _distance(codec: Spec, prepare: Callable[[str], str] | None = None):
    @F.arrow_udf("double")
    def apply(left: pa.Array, right: pa.Array) -> pa.Array:
        of, pair = codec.make().size, pair_size(codec)
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            if a is None or b is None:
                out.append(None)
                continue
            x, y = ((prepare(v) if prepare else v).encode() for v in (a, b))
            low, high = sorted((of(x), of(y)))
            both = pair(x, y)
            out.append(0.0 if both < low or not high else (both - low) / high)
        return pa.array(out, pa.float64())

    return apply


def register_all(spark: SparkSession) -> list[str]:
    """Registers ``ncd_size_*``, ``ncd_distance_*``, ``html_distance`` and the text functions; returns their names."""
    functions = {
        "html_structure": _text(lambda v: html.process(v, html.keep_attributes())),
        "html_strip_content": _text(lambda v: html.process(v, html.keep_attributes(None))),
        "wiki_content": _text(lambda v: article.article_content(v, *article.WIKI)),
        "grok_content": _text(lambda v: article.article_content(v, *article.GROK)),
        "clean_text": _text(article.clean_text),
        "html_distance": _distance(Spec("brotli_recommended"), lambda v: html.process(v, html.keep_attributes())),
    }
    for name in ("zstd", "brotli", "tokenset"):
        codec = Spec(f"{name}_recommended" if name != "tokenset" else name)
        functions[f"ncd_size_{name}"] = _size(codec)
        functions[f"ncd_distance_{name}"] = _distance(codec)
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
