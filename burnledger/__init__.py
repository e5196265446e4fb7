"""burnledger: partner-channel consumption billing on PySpark.

Layout
------
functions   column expressions and clock arithmetic
sources     schemas, table readers and writers, the test-table bridge
operators   joins, markup, isolation, pricing, drawdown, config edits, audits
plans       portfolio and customer reports, and the query registry

Every public operator takes and returns DataFrames, gets the point in time
(``as_of``) and the consumer explicitly, and starts no Spark job by itself.
"""

__version__ = "0.1.0"
