"""panelkit: Spark-native operators for repeated-measures rating tables.

Every public operator takes a DataFrame plus caller-chosen column names and
returns a DataFrame. Sub-packages:

* ``sources``   - scans, guards, sinks and the proxy fixture tables
* ``functions`` - Column-level helpers (portable randomness, encoders,
                  distribution tails, equation basis)
* ``operators`` - cleaning, splits, grouped statistics, metrics, ranks,
                  non-parametric tests, mixed models, equations, models,
                  explainability
* ``plans``     - registered end-to-end queries with their SQL oracles
* ``streaming`` - incremental use of the mergeable aggregates
"""

__version__ = "0.1.0"
