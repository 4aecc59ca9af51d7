"""epsgrid: exact density-based outlier detection on Spark DataFrames."""

from .operators.detect import (Detection, core_points, dbscan_noise, detect, detect_outliers,  # noqa: F401
                               label_points)
from .operators.stats import run_stats  # noqa: F401
from .session import checkpoint_dir, get_spark  # noqa: F401
