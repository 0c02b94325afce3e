"""Array files as Spark data sources: npy, npz and safetensors."""
