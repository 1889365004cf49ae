"""Structure-preserving masking of semi-structured payloads on Spark."""
