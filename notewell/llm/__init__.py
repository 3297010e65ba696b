"""Training-data operators: ten corpus-scale jobs over documents and web pages."""
