"""Fixed values of the analysis: results depend on each of them."""

SAMPLE_RATE = 22050
MIX_RATE = 44100
FPS = 50
HOP = 441
N_FFT = 1024
MEL_BANDS = 128
MEL_LOW, MEL_HIGH = 30.0, 11000.0
CHUNK, BORDER = 1500, 6
STRIDE = CHUNK - 2 * BORDER
PEAK_REACH = 3
MATCH_EPSILON = 0.001
INTERVAL_LOW, INTERVAL_HIGH = 0.1, 3.0
CLICK_LENGTH, CLICK_ATTACK, CLICK_DECAY = 0.1, 0.01, 0.05
DOWNBEAT_PITCH, BEAT_PITCH = 880.0, 440.0
ORIGINAL_GAIN, CLICK_GAIN = 0.7, 0.3
AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "ogg")
EVALUATION_WINDOW = 0.07
POSITION_TOLERANCE = 0.02
