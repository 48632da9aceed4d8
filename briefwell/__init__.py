"""A PySpark-native content-intelligence engine: articles in, an explained brief and reports out."""
