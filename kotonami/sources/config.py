"""Configuration: dictionaries, model, romaji table and keymap, as a YAML file; defaults for what it leaves out."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from kotonami.runtime import Folder
from kotonami.sources import yaml

ENCODINGS, TYPES, USAGES = ("Utf8", "EucJp"), ("SKK",), ("Normal", "SingleTerm", "Disabled")


@dataclass
class DictConfig:
    """One dictionary; without a usage it is disabled."""

    path: str = ""
    encoding: str = "Utf8"
    dict_type: str = "SKK"
    usage: str = "Disabled"

    def __post_init__(self) -> None:
        for value, allowed in ((self.encoding, ENCODINGS), (self.dict_type, TYPES), (self.usage, USAGES)):
            if value not in allowed:
                raise ValueError(f"unknown value: {value}")


@dataclass
class EngineConfig:
    dicts: list[DictConfig] = field(default_factory=list)
    dict_cache: bool = True
    model: str = "model/default"


@dataclass
class Config:
    romkan: str = "romkan/default.yml"
    keymap: str = "keymap/default.yml"
    live_conversion: bool = False
    engine: EngineConfig = field(default_factory=EngineConfig)


def find_resource(spark: SparkSession, name: str, folders: list[str]) -> str | None:
    """The first path `folder/name` that exists, the folders in order of precedence; null without any."""
    return next((f"{f.rstrip('/')}/{name}" for f in folders if Folder(spark, f).exists(name)), None)


def data_folders() -> list[str]:
    """Folders of data files in the usual order: the user's own, then the system's."""
    home = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
    return [home, *(os.environ.get("XDG_DATA_DIRS") or "/usr/local/share:/usr/share").split(":")]


def default_dictionaries(spark: SparkSession, folders: list[str]) -> list[DictConfig]:
    """The large public dictionary in EUC-JP, where one is found."""
    at = find_resource(spark, "skk/SKK-JISYO.L", folders)
    return [DictConfig(at, "EucJp", "SKK", "Normal")] if at else []


def from_dict(raw: dict, dicts: list[DictConfig] | None = None) -> Config:
    """A configuration of parsed YAML; without an engine it has `dicts`. Unknown names are left out."""
    own = lambda kind, d: kind(**{k: v for k, v in d.items() if k in kind.__dataclass_fields__ and v is not None})
    config = own(Config, {k: v for k, v in raw.items() if k != "engine"})
    engine = raw.get("engine")
    if engine is None:
        config.engine = EngineConfig(dicts=list(dicts or []))
    else:
        config.engine = own(EngineConfig, {k: v for k, v in engine.items() if k != "dicts"})
        config.engine.dicts = [own(DictConfig, d) for d in engine.get("dicts") or []]
    return config


def load(spark: SparkSession, folder: str, name: str = "config.yml", dicts: list[DictConfig] | None = None) -> Config:
    """The configuration in a folder of any file system; a missing or unreadable file gives the defaults."""
    text = Folder(spark, folder).read(name)
    try:
        return from_dict(yaml.load(text) or {} if text else {}, dicts)
    except ValueError:
        return from_dict({}, dicts)


def save(spark: SparkSession, config: Config, folder: str, name: str = "config.yml") -> None:
    """Write it as JSON, which is YAML too."""
    Folder(spark, folder).write(name, json.dumps(asdict(config), ensure_ascii=False, indent=1))
