"""Column functions that queries share."""

from tidemark.operators.frames import signed_bins
from tidemark.operators.overlap import iou, width_ratio
from tidemark.operators.symbols import cell_distance, cutlines, quantise
from tidemark.tables import clean_path, file_stem, session_name

__all__ = ["cell_distance", "clean_path", "cutlines", "file_stem", "iou", "quantise", "session_name", "signed_bins", "width_ratio"]
