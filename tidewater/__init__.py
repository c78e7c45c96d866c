"""A PySpark library of named DataFrame operators."""
