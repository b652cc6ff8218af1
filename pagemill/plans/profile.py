"""Processing profiles: plain nested dictionaries over declared defaults, read from and written to JSON."""

from __future__ import annotations

import copy
import json

INCHES = {"value": 0.0, "unit": "inches"}


def _inches(value: float) -> dict:
    return {"value": value, "unit": "inches"}


def _edges() -> dict:
    return {k: dict(INCHES) for k in ("top", "left", "right", "bottom")}


def _margins() -> dict:
    edges = {k: {"distance": dict(INCHES), "mode": "set" if k in ("top", "left") else "check"} for k in ("top", "left", "right", "bottom")}
    flags = {k: False for k in ("center_horizontal", "center_vertical", "keep_horizontal", "keep_vertical", "keep_h_center", "keep_v_center")}
    return {**edges, **flags, "keep_x": dict(INCHES), "keep_y": dict(INCHES)}


def _canvas() -> dict:
    return {"preset": "letter", "width": _inches(8.5), "height": _inches(11.0), "orientation": "portrait"}


# Names, defaults and enum values of the profile format.
DEFAULTS = {
    "name": "", "working_unit": "inches", "detected_dpi": -1, "detected_width": -1, "detected_height": -1,
    "position_image": True, "keep_outside_subimage": False, "keep_original_size": True, "odd_even_mode": False, "rotation": "none",
    "canvas": _canvas(), "margins": [_margins(), _margins()], "offsets": [{"x": dict(INCHES), "y": dict(INCHES)}, {"x": dict(INCHES), "y": dict(INCHES)}],
    "deskew": {
        "enabled": False, "detect_mode": 2, "min_angle": 0.05, "max_angle": 3.0, "fast": False, "border_protect": False, "interpolate": False,
        "character_protect": False, "char_protect_below": 1.0, "algorithm": 0, "report_no_skew": False,
    },
    "despeckle": {"mode": "none", "object_min": 1, "object_max": 1},
    "edge_cleanup": {"enabled": False, "order": "before_deskew", "set1": _edges(), "set2": _edges()},
    "hole_cleanup": {"enabled": False, "set1": _edges(), "set2": _edges()},
    "subimage": {"max_width": dict(INCHES), "max_height": dict(INCHES), "report_small": False, "min_width_px": 20, "min_height_px": 20},
    "blank_page": {"enabled": False, "threshold_percent": 0.5, "min_components": 0, "edge_margin": dict(INCHES)},
    "color_dropout": {"enabled": False, "color": "none", "threshold": 30},
    "movement_limit": {"enabled": False, "max_vertical": _inches(6.0), "max_horizontal": _inches(4.0)},
    "resize": {
        "enabled": False, "margins_set1": _edges(), "margins_set2": _edges(), "source": "subimage", "source_set1": _edges(), "source_set2": _edges(), "anti_alias": False, "keep_size": True,
        "canvas": _canvas(), "v_alignment": "center", "h_alignment": "center", "allow_shrink": True, "allow_enlarge": True,
        "output_path": "", "merge_tiff": False, "merge_pdf": False, "merge_tiff_name": "", "merge_pdf_name": "",
    },
    "output": {
        "tiff_output": True, "pdf_output": False, "raster_format": "jpeg", "jpeg_quality": 75, "new_extension": "", "save_to_different_dir": True, "output_directory": "",
        "conflict_policy": "overwrite", "path_mode": "portable",
    },
    "scan": {
        "prefix": "01_", "start_at": 1, "increment": 1, "extension": "tif", "crop": False, "verso_recto": False, "invert": False, "transfer_mode": 0, "compression": 0, "force_resolution": -1,
        "crop_verso": _edges(), "crop_recto": _edges(),
    },
    "print": {"page_use_mode": 0, "scale_mode": 0, "scale_x": 100.0, "scale_y": 100.0},
    "page_detection_style_sheet": "Factory defaults",
}
ENUMS = {
    "unit": ("inches", "pixels", "millimeters"), "working_unit": ("inches", "pixels", "millimeters"), "rotation": ("none", "cw90", "ccw90", "180"),
    "preset": ("autodetect", "letter", "legal", "tabloid", "a4", "a3", "custom"), "orientation": ("portrait", "landscape"), "order": ("before_deskew", "after_deskew"),
    "color": ("none", "red", "green", "blue"), "source": ("subimage", "full_page", "custom", "smart"), "v_alignment": ("top", "center", "bottom", "proportional"),
    "h_alignment": ("center", "proportional"), "raster_format": ("raw", "ccitt4", "lzw", "jpeg"), "conflict_policy": ("report", "overwrite"), "path_mode": ("portable", "absolute"),
}
ALIASES = {"in": "inches", "px": "pixels", "mm": "millimeters", "auto": "autodetect", "g4": "ccitt4", "jpg": "jpeg", "r": "red", "g": "green", "b": "blue"}
MODES = {"despeckle": ("none", "single_pixel", "object"), "margin": ("set", "check")}


class ProfileError(ValueError):
    pass


def profile(**changes) -> dict:
    """The default profile with nested changes."""
    return _merged(DEFAULTS, changes, "")


def _merged(base, said, path: str):
    if isinstance(base, dict):
        if not isinstance(said, dict):
            raise ProfileError(f"{path or 'profile'} is not an object")
        out = copy.deepcopy(base)
        for k, v in said.items():
            if k in base:
                out[k] = _merged(base[k], v, f"{path}.{k}".lstrip("."))
        return out
    if isinstance(base, list):
        if not isinstance(said, list):
            raise ProfileError(f"{path} is not a list")
        return [_merged(b, said[i], f"{path}[{i}]") if i < len(said) else copy.deepcopy(b) for i, b in enumerate(base)]
    key = path.rpartition(".")[2]
    allowed = ENUMS.get(key) or (MODES["despeckle"] if path == "despeckle.mode" else MODES["margin"] if key == "mode" else None)
    if allowed:
        name = ALIASES.get(str(said).lower(), str(said).lower())
        if name not in allowed:
            raise ProfileError(f"{path}: unknown value {said}")
        return name
    if isinstance(base, bool) != isinstance(said, bool) or (isinstance(base, str) != isinstance(said, str)):
        raise ProfileError(f"{path}: wrong kind of value {said!r}")
    if path == "color_dropout.threshold" and not 0 <= said <= 255:
        raise ProfileError(f"{path}: {said} is not in 0 to 255")
    if isinstance(base, int) and not isinstance(base, bool) and int(said) != said:
        raise ProfileError(f"{path}: {said} is not a whole number")
    return type(base)(said)


def from_json(text: str) -> dict:
    """A profile; unknown keys are skipped, missing ones default, an unknown enum value rejects the whole."""
    try:
        return _merged(DEFAULTS, json.loads(text), "")
    except (json.JSONDecodeError, TypeError) as e:
        raise ProfileError(str(e)) from e


def to_json(p: dict) -> str:
    return json.dumps(p, indent=2, ensure_ascii=False)


def merge(p: dict, changes: dict) -> dict:
    return _merged(p, changes, "")
