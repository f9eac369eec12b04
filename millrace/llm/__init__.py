"""Operations of a training-data pipeline; nothing else in the library imports this subpackage.

Each module ``<name>`` holds one operator with its own general interface, the
digest query ``query(spark, sf_dir)`` and, where SQL can express the result,
``ORACLE``. The queries are collected by :mod:`millrace.llm.catalog`.
"""
