"""faultsift: rank source files by how likely a bug report needs them fixed, on Spark."""
