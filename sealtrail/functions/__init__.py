"""Column functions: compositions of Spark built-ins, but for ``residue_arrays``, which works on Arrow batches."""
