"""Price and community intelligence over product listings, as PySpark DataFrame functions."""
