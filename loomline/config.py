"""Extraction parameters, presets and their files."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    sample_interval: float = 2.0
    active_interval: float = 0.50
    active_window: float = 8.0
    scene_threshold: float = 0.065
    ocr_change_similarity: float = 0.965
    ocr_heartbeat: float = 3.0
    ocr_retry_confidence: float = 0.62
    min_ocr_chars: int = 4
    min_luma: float = 8.0
    jpeg_quality: int = 92
    speech_model: str = "small"
    language: str | None = None
    context_radius: float = 10.0
    output_formats: tuple[str, ...] = ("md", "json")


# Fixed values of the presets.
PRESETS = {
    "default": Config(),
    "lecture": Config(),
    "coding": Config(sample_interval=1.5, active_interval=0.40, active_window=10.0, ocr_change_similarity=0.950, ocr_heartbeat=2.0, output_formats=("md", "json", "html")),
    "meeting": Config(sample_interval=5.0, active_interval=2.0, active_window=5.0, ocr_change_similarity=0.980, ocr_heartbeat=10.0, output_formats=("md", "json", "srt")),
    "tutorial": Config(ocr_change_similarity=0.960, output_formats=("md", "json", "html", "srt")),
}


def preset(name: str) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}: one of {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def with_values(base: Config, values: dict) -> Config:
    """``base`` with the known keys of ``values``; unknown keys are dropped, lists of formats are honoured."""
    known = {f.name for f in fields(Config)}
    chosen = {k: tuple(v) if k == "output_formats" else v for k, v in values.items() if k in known and v is not None}
    return replace(base, **chosen)


def load_config(path: str, base: Config | None = None) -> Config:
    """Flat ``key: value`` YAML (lists in brackets or dashes), which is all that presets use."""
    values: dict[str, object] = {}
    key = None
    with open(path, encoding="utf-8") as f:
        for raw in f:
            line = raw.split("#", 1)[0].rstrip()
            if not line.strip():
                continue
            if line.lstrip().startswith("- ") and key:
                held = values.get(key)
                values[key] = [*(held if isinstance(held, list) else []), line.lstrip()[2:].strip().strip("'\"")]
                continue
            key, _, value = (x.strip() for x in line.partition(":"))
            values[key] = _scalar(value)
    return with_values(base or Config(), values)


def _scalar(value: str) -> object:
    if value.startswith("[") and value.endswith("]"):
        return [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()]
    if value.lower() in ("", "null", "~", "none"):
        return None
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("'\"")
