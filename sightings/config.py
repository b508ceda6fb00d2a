"""Runtime parameters. Defaults are part of the contract and equal the reference's.

Fixed values (must equal the reference):
  capture interval 2.0 s, capture timeout 3.0 s, phase 0.0 s
  detector confidence 0.25, crop padding 100 px
  keep last annotated frames 10
  minimum alert confidence 0.0
  same-species repeat 60 s, song every 10 s, songs enabled
  failure log quiet period 5 s, backoff step 0.2 s, backoff cap 5.0 s
  event QoS 0, retain state true
  minimum samples per class 5, input size 320, batch size 16, epochs 30, learning rate 1e-4,
  weight decay 0.01, train fraction 0.8
  detector model file "yolov8s.pt", classifier model file "bird_classifier.onnx"
  normalisation mean (0.485, 0.456, 0.406), std (0.229, 0.224, 0.225)
  frame corruption: row std threshold 2.0, flat row ratio 0.3
"""

CAPTURE_INTERVAL_S = 2.0
CAPTURE_TIMEOUT_S = 3.0
CAPTURE_PHASE_S = 0.0
DETECT_CONF = 0.25
DETECT_PADDING = 100
KEEP_LAST_ANNOTATED = 10
MIN_ALERT_CONF = 0.0
SAME_SPECIES_REPEAT_S = 60.0
SONG_EVERY_S = 10.0
SONGS_ENABLED = True
FAILURE_LOG_QUIET_S = 5.0
BACKOFF_STEP_S = 0.2
BACKOFF_CAP_S = 5.0
MQTT_QOS = 0
RETAIN_STATE = True
MIN_SAMPLES = 5
INPUT_SIZE = 320
BATCH_SIZE = 16
EPOCHS = 30
LEARNING_RATE = 1e-4
WEIGHT_DECAY = 0.01
TRAIN_FRACTION = 0.8
DETECTOR_MODEL = "yolov8s.pt"
CLASSIFIER_MODEL = "bird_classifier.onnx"
NORM_MEAN = (0.485, 0.456, 0.406)
NORM_STD = (0.229, 0.224, 0.225)
LOW_STD = 2.0
FLAT_RATIO = 0.3

# Frame geometry of the fixture camera (FIXTURES.md): 1920 x 1080.
FRAME_W = 1920
FRAME_H = 1080

# size of a latency sketch: its rank error is about 0.3 % at 1000
LATENCY_SKETCH_K = 1000
LATENCY_RANK_ERROR = 0.01
