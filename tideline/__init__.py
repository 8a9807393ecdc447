"""Change-data-capture, reconciliation and order documents on Spark.

Every public function takes and returns DataFrames or Columns, so the whole
library composes into one logical plan that Catalyst optimises.
"""

__version__ = "0.1.0"
