"""Quality checks, staging and analysis of retail receipt data on PySpark.

Subpackages:

* ``functions`` - column helpers (missing values, text, casts, dates)
* ``sources``   - schemas, CSV import, stored tables
* ``operators`` - checks, staging, integration and analytics; DataFrame in, DataFrame out
* ``plans``     - session settings, scratch storage, one-scan profiles, named reports
"""

__version__ = "0.1.0"
