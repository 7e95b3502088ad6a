"""Saving and loading of imputers, alone or as stages of a pipeline."""

from __future__ import annotations

import base64
import pickle

from pyspark import cloudpickle
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class Saved(MLWritable, MLReadable):
    """For transformers that are made of what ``get_params`` tells; estimator objects are pickled."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: Saved):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        packed = base64.b64encode(cloudpickle.dumps(self.instance.get_params())).decode()
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"given": packed})


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Saved:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(**pickle.loads(base64.b64decode(found["given"])))
        out._resetUid(found["uid"])
        return out
