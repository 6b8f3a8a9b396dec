"""veriframe: measuring how reliable generated answers are, as Spark DataFrame plans."""
