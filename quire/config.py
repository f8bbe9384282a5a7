"""Settings that have an effect, as frozen dataclasses; unknown names are rejected at every level. Names, defaults and ranges are fixed values."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


class ConfigError(ValueError):
    """A setting is unknown or out of its range."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class ImageConfig:
    enabled: bool = True
    deskew: bool = True
    denoise: bool = False
    enhance_contrast: bool = True
    remove_borders: bool = True
    crop_margins: bool = True
    binarization: str = "adaptive_gaussian"
    target_dpi: int = 300
    max_dimension_px: int = 6000

    def __post_init__(self) -> None:
        _check(self.binarization in ("none", "otsu", "adaptive_gaussian", "sauvola"), "binarization: none, otsu, adaptive_gaussian or sauvola")
        _check(72 <= self.target_dpi <= 1200, "target_dpi: 72 to 1200")
        _check(self.max_dimension_px >= 1000, "max_dimension_px: 1000 or more")


@dataclass(frozen=True)
class LayoutConfig:
    analyzer: str = "heuristic"
    detect_columns: bool = True
    max_columns: int = 4
    detect_headers: bool = True
    detect_footers: bool = True
    detect_footnotes: bool = True
    detect_page_numbers: bool = True
    remove_headers: bool = False
    remove_footers: bool = False
    remove_page_numbers: bool = False

    def __post_init__(self) -> None:
        _check(1 <= self.max_columns <= 8, "max_columns: 1 to 8")


@dataclass(frozen=True)
class OcrConfig:
    engine: str = "tesseract"
    psm: int = 3
    oem: int = 1
    detect_bold_italic: bool = True
    languages: tuple[str, ...] = ("spa", "eng")
    min_confidence: float = 40.0

    def __post_init__(self) -> None:
        _check(bool(self.languages), "languages: one at least")
        _check(0 <= self.min_confidence <= 100, "min_confidence: 0 to 100")
        _check(0 <= self.psm <= 13, "psm: 0 to 13")
        _check(0 <= self.oem <= 3, "oem: 0 to 3")


@dataclass(frozen=True)
class TranslationConfig:
    enabled: bool = False
    engine: str = "none"
    source_language: str | None = None
    target_language: str = "en"


@dataclass(frozen=True)
class ExportConfig:
    formats: tuple[str, ...] = ("markdown",)
    output_dir: str = "./output"

    def __post_init__(self) -> None:
        known = ("txt", "markdown", "html", "docx", "epub")
        _check(bool(self.formats) and set(self.formats) <= set(known), f"formats: one at least of {', '.join(known)}")


@dataclass(frozen=True)
class Config:
    image: ImageConfig = field(default_factory=ImageConfig)
    layout: LayoutConfig = field(default_factory=LayoutConfig)
    ocr: OcrConfig = field(default_factory=OcrConfig)
    translation: TranslationConfig = field(default_factory=TranslationConfig)
    export: ExportConfig = field(default_factory=ExportConfig)

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        parts = {f.name: f.default_factory for f in fields(cls)}
        _check(set(given) <= set(parts), f"unknown sections: {sorted(set(given) - set(parts))}")
        made = {}
        for name, own in given.items():
            kind = parts[name]
            known = {f.name for f in fields(kind)}
            _check(set(own) <= known, f"{name}: unknown settings {sorted(set(own) - known)}")
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
        return cls(**made)

    def to_dict(self) -> dict:
        return asdict(self)


def load(path: str | None) -> Config:
    """From a YAML file; None gives the defaults."""
    if path is None:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.from_dict(yaml.safe_load(f) or {})


def save(config: Config, path: str) -> None:
    import yaml

    plain = {k: {n: list(v) if isinstance(v, tuple) else v for n, v in own.items()} for k, own in config.to_dict().items()}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(plain, f, allow_unicode=True, sort_keys=False)
