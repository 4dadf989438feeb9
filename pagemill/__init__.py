"""A PySpark-native engine that turns folders of mixed documents into Markdown bundles."""
