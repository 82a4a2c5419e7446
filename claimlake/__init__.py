"""Evidence-governed claim tables as plain PySpark DataFrame functions."""
