"""A PySpark engine for moving, profiling and serving relational datasets as documents."""
