"""postlens: social-post analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) and never
collects data to the driver; fitted-model metadata is the only exception.
"""

__version__ = "0.1.0"
