"""Media-evidence analytics as plain ``DataFrame -> DataFrame`` functions."""
