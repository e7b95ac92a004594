"""Part of the document analytics engine; see README.md."""
