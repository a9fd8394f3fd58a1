"""Training-data operators (documents, pages and conversations). Nothing else in the library imports this subpackage."""
