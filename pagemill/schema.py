"""Schemas of the job and page relations."""

from __future__ import annotations

JOB_STATES = ("submitted", "validating", "rendering", "exception", "completed", "cancelled")
FINISHED = ("completed", "cancelled")
ACTIVE = ("validating", "rendering")

JOB = (
    "id string, state string, source_path string, profile_name string, attachments array<string>, tags array<string>, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, correlation_id string, error_message string, priority int, "
    "attempt_count bigint, last_attempt_at timestamp_ntz, due_at timestamp_ntz"
)
JOB_COLUMNS = tuple(c.split()[0] for c in JOB.split(", "))

EVENT = "seq bigint, job_id string, state string, message string"

#: A page: tight rows from the top, one-bit pages packed from the high bit with 1 for ink.
PAGE = "image_id bigint, page_index int, width int, height int, format int, dpi_x double, dpi_y double, data binary"

COMPONENT = "image_id bigint, label bigint, left int, top int, right int, bottom int, pixel_count bigint"
