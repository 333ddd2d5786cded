"""Settings: files in layers, options of requests as columns, and the choice of a backend and model."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.pipeline import PRESETS, Options

#: Names looked for in the working folder and the user's configuration folder, in this order.
NAMES = ("rasterloom.yaml", "rasterloom.yml", "rasterloom.toml", "rasterloom.json")
VARIABLE = "RASTERLOOM_CONFIG"
_KINDS = {"float": "double", "int": "int", "bool": "boolean", "str": "string"}


class ConfigError(ValueError):
    pass


def read_file(path: str | Path) -> dict:
    """A YAML, TOML or JSON file; its top level must be a mapping."""
    path = Path(path)
    try:
        text = path.read_text()
    except OSError as e:
        raise ConfigError(f"{path} can't be read") from e
    if path.suffix in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = tomllib.loads(text) if path.suffix == ".toml" else json.loads(text)
    if found is None:
        found = {}
    if not isinstance(found, dict):
        raise ConfigError(f"{path} doesn't hold a mapping")
    return found


def discover(explicit: str | None = None) -> Path | None:
    """The settings file: the one named, else that of the environment variable, else the first there in the usual places."""
    for named in (explicit, os.environ.get(VARIABLE)):
        if named:
            if not Path(named).is_file():
                raise ConfigError(f"{named} isn't there")
            return Path(named)
    places = (Path(folder) / name for folder in (Path.cwd(), Path.home() / ".config" / "rasterloom") for name in NAMES)
    return next((p for p in places if p.is_file()), None)


def load(path: str | None = None, **flags) -> Options:
    """Defaults of the preset (default), then the file's, then flags; flags that are None count as absent."""
    found = discover(path)
    layer = read_file(found) if found else {}
    unknown = set(layer) - {"preset", "options"}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    base = PRESETS[layer.get("preset", "default")]
    values = {f.name: getattr(base, f.name) for f in fields(Options) if f.name != "extra"}
    return Options.of(values | layer.get("options", {}) | {k: v for k, v in flags.items() if v is not None})


def options_from(payload: Column, defaults: Options) -> Column:
    """struct of options from a map<string, string>: values that can't be cast and missing ones take the default, unknown keys are left out."""
    out = []
    for f in fields(Options):
        if f.name == "extra":
            continue
        kind = next(v for k, v in _KINDS.items() if str(f.type).startswith(k))
        default = F.lit(getattr(defaults, f.name)).cast(kind)
        out.append(F.coalesce(F.try_element_at(payload, F.lit(f.name)).try_cast(kind), default).alias(f.name))
    return F.struct(*out)


def extras(payload: Column) -> Column:
    """map of the keys of a payload that aren't options."""
    known = [f.name for f in fields(Options)]
    return F.map_filter(payload, lambda k, _: ~k.isin(*known))


def form_fields(form: Column, nested: str = "options") -> Column:
    """A form as one map: a field that holds a JSON object is merged over the others."""
    inner = F.from_json(F.try_element_at(form, F.lit(nested)), "map<string,string>")
    rest = F.map_filter(form, lambda k, _: k != nested)
    return F.when(inner.isNull(), form).otherwise(F.map_concat(F.map_filter(rest, lambda k, _: ~F.map_contains_key(inner, k)), inner))


def backend_name(backend: Column, model_path: Column, onnx: Column, weights: Column) -> Column:
    """The backend of a request: the one named, else by the model's extension, else what files there are, else classical."""
    ext = F.lower(F.regexp_extract(model_path, r"\.([A-Za-z0-9]+)$", 1))
    auto = F.when(ext == "onnx", "onnx").when(ext.isin("pth", "pt", "ckpt"), "torch").when(onnx.isNotNull(), "onnx").when(weights.isNotNull(), "torch").otherwise("classical")
    return F.when(F.coalesce(backend, F.lit("auto")) != "auto", backend).otherwise(auto)


def resolve_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests (model, ...) with the model's row, or an error for a name that is neither known nor a path of a file or classical."""
    d = requests.join(models.withColumnRenamed("name", "model"), "model", "left")
    local = F.col("model").rlike(r"\.(onnx|pth|pt|ckpt)$")
    return d.withColumn("error", F.when(F.col("arch").isNull() & ~local & (F.col("model") != "classical"), F.concat(F.lit("unknown model "), F.col("model"))))
