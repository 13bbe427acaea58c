"""Bundled profiles: page limits, margins, columns and body sizes of venues.

The numbers are fixed values of the venues' calls; texts are in our own words."""

from __future__ import annotations

_CORE = ["core.geometry", "core.fonts", "core.structure", "core.headings", "core.hidden", "core.pdf", "core.prose", "core.statistics", "core.citations", "integrations.refcheck"]


def _letter(left: float, right: float, top: float, bottom: float) -> dict:
    return {"page_pt": [612, 792], "margins": {"left_pt": left, "right_pt": right, "top_pt": top, "bottom_pt": bottom}}


PROFILES: dict[str, dict] = {
    "base": {"modules": _CORE, "page_pt": [595, 842], "margins": {"left_pt": 71, "right_pt": 71, "top_pt": 57, "bottom_pt": 62}, "columns": 2, "fonts": {"body_sizes_pt": [11], "min_size_pt": 9}, "prose": {"sentence_hard_max_words": 46, "sentence_soft_max_words": 36, "repeated_opener_run": 3, "repeated_opener_ignore": ["the", "this", "we", "it", "in", "for", "to", "a", "as"]}, "tracks": {"main": {"limit": None}}, "default_track": "main"},
    "acl": {"extends": "base", "modules": ["core.anonymity"]},
    "arr": {"extends": "acl", "modules": ["arr.responsible_nlp"], "tracks": {"long": {"limit": 8}, "short": {"limit": 4}, "demo": {"limit": 6}}, "default_track": "long"},
    "neurips": {"extends": "base", "modules": ["neurips.checklist"], **_letter(108, 108, 72, 72), "columns": 1, "fonts": {"body_sizes_pt": [10], "min_size_pt": 8}, "tracks": {"main": {"limit": 9}}, "severity_overrides": {"limitations_present": "warning"}},
    "baylearn": {"extends": "neurips", "tracks": {"main": {"limit": 2}}},
    "iclr": {"extends": "base", **_letter(108, 108, 82, 62), "columns": 1, "fonts": {"body_sizes_pt": [10], "min_size_pt": 8}, "tracks": {"main": {"limit": 9}, "camera": {"limit": 10}}, "severity_overrides": {"page_limit": "error"}},
    "icml": {"extends": "base", **_letter(55.44, 70.56, 67.06, 76.94), "fonts": {"body_sizes_pt": [10], "min_size_pt": 9}, "tracks": {"main": {"limit": 8}, "position": {"limit": 8}, "camera": {"limit": 9}}, "severity_overrides": {"page_limit": "error", "margins": "warning"}},
    "cvpr": {"extends": "base", **_letter(58.5, 58.5, 72, 81), "fonts": {"body_sizes_pt": [10], "min_size_pt": 8}, "tracks": {"main": {"limit": 8}, "rebuttal": {"limit": 1}}, "severity_overrides": {"margins": "warning", "body_font_size": "warning", "hidden_invisible_text": "error"}},
    "aaai": {"extends": "base", **_letter(54, 54, 54, 90), "fonts": {"body_sizes_pt": [10], "min_size_pt": 9}, "tracks": {"main": {"limit": 7}, "student": {"limit": 2}}, "severity_overrides": {"page_limit": "warning", "margins": "warning"}},
    "aistats": {"extends": "base", **_letter(63, 63, 72, 54), "fonts": {"body_sizes_pt": [10], "min_size_pt": 8}, "tracks": {"main": {"limit": 8}, "camera": {"limit": 9}}, "severity_overrides": {"margins": "warning"}},
    "icra": {"extends": "base", **_letter(54, 54, 50, 58), "fonts": {"body_sizes_pt": [10], "min_size_pt": 8}, "tracks": {"main": {"limit": 8}}, "severity_overrides": {"pdf_health": "error", "margins": "warning"}},
    "icassp": {"extends": "base", **_letter(53.9, 53.6, 72, 70.9), "fonts": {"body_sizes_pt": [10], "min_size_pt": 9}, "tracks": {"main": {"limit": 4, "settings": {"total": 5}}}, "severity_overrides": {"pdf_health": "error", "margins": "warning"}},
    "arxiv": {"extends": "base", "modules_replace": ["core.structure", "core.headings", "core.hidden", "core.pdf", "core.prose", "core.statistics", "integrations.refcheck"], "disabled_checks": ["limitations_present"]},
}
