"""Rollups that follow a growing folder of report files."""

from .weekly import read_weekly, stream_weekly

__all__ = ["read_weekly", "stream_weekly"]
