"""Peptidoform deconvolution and quantification as Spark DataFrame jobs."""
