"""The canonical coordinate stream: constants, schemas, and the pair of tables that operators take.

Every operator works within (match_id, segment_id): a segment is one contiguous
stretch of play, and nothing crosses it.  That pair is the partition key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Pitch in metres, origin bottom left.
LENGTH, WIDTH = 105.0, 68.0
HOME, AWAY = "home", "away"
SEGMENT = ["match_id", "segment_id"]
FRAME = [*SEGMENT, "frame_idx"]

FRAMES = (
    "match_id string, segment_id int, frame_idx int, t double, t_ms long, period int, ball_x double, ball_y double, att_home int, att_away int"
)
POSITIONS = (
    "match_id string, segment_id int, frame_idx int, t double, t_ms long, ord int, track_id string, team string, x double, y double"
)
DETECTIONS = (
    "match_id string, segment_id int, type string, players array<string>, geometry string, confidence double, t_start double, t_end double"
)


@dataclass(frozen=True)
class Tables:
    """One row a frame, and one row a player and frame (``ord``: the player's place in its frame)."""

    frames: DataFrame
    positions: DataFrame

    def cached(self) -> Tables:
        return Tables(self.frames.cache(), self.positions.cache())
