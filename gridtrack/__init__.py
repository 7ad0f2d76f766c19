"""Detection, linking and description of evolving regions in gridded data."""

from gridtrack.config import TrackConfig

__all__ = ["TrackConfig"]
