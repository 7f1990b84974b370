"""End-to-end experiments assembled from the operators."""
